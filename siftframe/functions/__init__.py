"""Column expressions and helpers."""
