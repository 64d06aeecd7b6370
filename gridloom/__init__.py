"""gridloom: multi-dimensional arrays and sparse matrices as Spark tables."""
