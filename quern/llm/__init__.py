"""Operators for preparing training data: one module each, and `queries` to register them."""
