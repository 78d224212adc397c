"""Column expressions; nothing in here reads data."""
