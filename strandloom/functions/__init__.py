"""Column functions and the small vector helpers used inside tasks."""
