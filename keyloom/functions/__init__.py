"""Column functions: vectors, scalars and record parsers."""
