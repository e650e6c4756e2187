"""Column functions: pure expressions, no shuffle, no Python workers."""
