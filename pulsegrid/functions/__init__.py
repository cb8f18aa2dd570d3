"""Column functions and configuration checks."""
