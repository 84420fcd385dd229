"""plans of the conflict engine."""
