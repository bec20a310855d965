"""tomelake operators."""
