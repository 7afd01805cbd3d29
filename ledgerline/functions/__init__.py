"""Functions of the panel engine."""
