"""tomelake streaming."""
