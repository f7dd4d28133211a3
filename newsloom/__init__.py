"""Topic ranking and training-data operators for Spark."""
