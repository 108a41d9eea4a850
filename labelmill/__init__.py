"""Drug-label analytics on Spark DataFrames."""
