"""streaming of the conflict engine."""
