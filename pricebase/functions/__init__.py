"""Column-level building blocks (no Python UDF)."""
