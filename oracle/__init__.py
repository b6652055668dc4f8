"""DuckDB statements that state each query a second time."""
