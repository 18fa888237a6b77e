"""Column builders and fixed word lists."""
