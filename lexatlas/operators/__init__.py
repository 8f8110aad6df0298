"""Operators of the atlas as DataFrame plans, one module per family."""
