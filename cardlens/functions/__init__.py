"""Column expressions and the distributed ranking helpers shared by the operators."""
