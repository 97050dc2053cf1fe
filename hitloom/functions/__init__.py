"""Column expressions: built-in functions only, but for IPv6 addresses."""
