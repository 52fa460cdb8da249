"""Sources and sinks: layered parquet tables, job slices, upsert, slice overwrite, publish."""
