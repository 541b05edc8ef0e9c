"""Document-graph analytics on Spark."""
