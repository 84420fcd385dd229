"""sources of the conflict engine."""
