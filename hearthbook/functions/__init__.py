"""Column functions: all built-in Spark expressions, no Python per row."""
