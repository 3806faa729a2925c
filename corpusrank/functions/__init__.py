"""Column-expression functions (no Python per row)."""
