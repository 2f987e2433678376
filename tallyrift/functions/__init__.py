"""Column expressions without any action or shuffle."""
