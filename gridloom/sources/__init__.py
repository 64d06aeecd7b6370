"""Arrays in folders, and views of plain tables as arrays."""
