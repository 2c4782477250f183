"""Column-level functions and fixed values."""
