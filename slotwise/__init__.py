"""Log-lifecycle analytics on Spark DataFrames."""
