"""Log analytics and data processing on Spark DataFrames."""
