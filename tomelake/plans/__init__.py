"""tomelake plans."""
