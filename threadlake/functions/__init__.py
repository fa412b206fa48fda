"""Column expressions (built-in functions only, except the Arrow embedder)."""
