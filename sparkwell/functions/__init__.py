"""Column expressions: text, vectors, rounding, query understanding."""
