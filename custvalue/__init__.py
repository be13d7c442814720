"""Customer-value analytics as DataFrame and Spark ML jobs."""
