"""Sources of the panel engine."""
