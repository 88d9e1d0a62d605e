"""Document indexing and hybrid retrieval on Spark DataFrames."""
