"""Column expressions and small vectorized helpers."""
