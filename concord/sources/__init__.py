"""Reading catalog exports into neutral tables."""
