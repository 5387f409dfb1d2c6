"""Natural-hazard risk analytics as Spark DataFrame and Structured Streaming operators."""
