"""Column expressions; all native, no Python UDF."""
