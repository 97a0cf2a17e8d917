"""Public-opinion analytics on Spark DataFrames."""
