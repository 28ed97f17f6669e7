"""Graph sources and sinks: driver tables, GraphSON, versioned Parquet, saved queries."""
