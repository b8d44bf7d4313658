"""Document index and retrieval on Spark DataFrames."""
