"""boundgraph: bounded property-graph analytics on Spark."""
