"""Column functions: text, numbers, similarity."""
