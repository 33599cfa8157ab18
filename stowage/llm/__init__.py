"""Training-data operators: one module an operator, all usable alone."""
