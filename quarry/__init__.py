"""quarry: hybrid document search and corpus preparation on Spark DataFrames."""
