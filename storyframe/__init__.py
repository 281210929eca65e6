"""Time-coded media annotation analytics on Spark DataFrames."""
