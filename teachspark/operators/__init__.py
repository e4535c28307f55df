"""DataFrame operators (one module per group of SURVEY section 2)."""
