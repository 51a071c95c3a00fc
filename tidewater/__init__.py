"""Click-stream fraud analytics on Spark."""
