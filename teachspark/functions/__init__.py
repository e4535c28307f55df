"""Column-level functions (native Spark expressions, no Python UDFs)."""
