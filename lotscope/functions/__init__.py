"""Column functions. All of them are native expressions, so Catalyst sees through every call."""
