"""Roll-call analytics on Spark DataFrames."""
