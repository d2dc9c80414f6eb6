"""Column expressions and join/hash helpers shared by the operators."""
