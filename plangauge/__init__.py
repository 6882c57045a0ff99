"""Floor-plan quality analytics on Spark DataFrames."""
