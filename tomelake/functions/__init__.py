"""tomelake functions."""
