"""Table schemas, typed readers, writers and the bridge from the benchmark tables."""
