"""tomelake sources."""
