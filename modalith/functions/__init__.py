"""Column expressions: text, parsing, statistics."""
