"""Column expressions: text, prices, query understanding, result formatting."""
