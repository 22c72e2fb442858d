"""Column functions, without tables of their own."""
