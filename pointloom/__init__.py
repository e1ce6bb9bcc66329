"""Point-cloud and capture-project analytics as ordinary Spark DataFrame operations."""
