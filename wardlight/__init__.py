"""Hospital-encounter analytics on Spark."""
