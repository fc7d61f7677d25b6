"""Full-text search and corpus processing on Spark."""
