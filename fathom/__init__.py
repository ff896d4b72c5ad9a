"""Document analytics on Spark: scope, retrieval, evidence and evaluation operators as DataFrame queries."""
