"""partgraph: iterative graph analytics on Spark DataFrames."""
