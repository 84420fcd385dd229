"""functions of the conflict engine."""
