"""Query-log analytics on Spark."""
