"""Operators bound to the given tables."""
