"""Mail-archive analytics on Spark DataFrames."""
