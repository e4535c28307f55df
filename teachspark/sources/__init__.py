"""Sources and sinks: parquet tables, instruction rows, prepared data, metrics, snapshots."""
