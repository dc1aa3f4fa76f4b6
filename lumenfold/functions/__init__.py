"""Column expressions: geometry, text, magnification lookups."""
