"""Column functions of arrays."""
