"""Assessment and content-quality analytics on Spark DataFrames."""
