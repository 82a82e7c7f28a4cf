"""lodestack: knowledge-base analytics on Spark DataFrames."""
