"""Grammar-driven span analytics on Spark."""
