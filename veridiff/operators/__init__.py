"""operators of the conflict engine."""
