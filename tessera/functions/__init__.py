"""Column functions: text, geography, vectors, expressions and JSON."""
