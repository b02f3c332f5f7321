"""Archives as they arrive."""
