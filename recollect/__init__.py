"""Memory-based learning on Spark DataFrames."""
