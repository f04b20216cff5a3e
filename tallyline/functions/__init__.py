"""Column expressions: wire formats and scalar functions."""
