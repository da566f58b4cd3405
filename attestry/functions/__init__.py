"""Column expressions and byte-level functions."""
