"""Column expressions; every one stays inside Catalyst."""
