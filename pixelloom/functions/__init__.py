"""Column functions: pure expressions, no shuffle, no Python at run time."""
