"""Operator families, one module each."""
