"""Text search and analytics on Spark DataFrames."""
