"""Drug-safety analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
