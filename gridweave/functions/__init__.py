"""Column expressions: patterns, categories, values, ids."""
