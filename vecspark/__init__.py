"""Vector similarity search and its evaluation as Spark jobs."""
