"""Document-block analytics on Spark."""
