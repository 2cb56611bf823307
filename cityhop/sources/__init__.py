"""Table sources and sinks: GTFS CSV feeds, Parquet, and the driver-table binding."""
