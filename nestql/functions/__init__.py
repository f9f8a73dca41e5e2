"""Column functions that the operators are composed of."""
