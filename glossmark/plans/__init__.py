"""Operators bound to the given tables, each beside its SQL."""
