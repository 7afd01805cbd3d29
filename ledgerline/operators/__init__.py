"""Operators of the panel engine."""
