"""Performance analytics on Spark."""
