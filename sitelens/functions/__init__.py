"""Column expressions and Arrow functions used by the operators."""
