"""Library-catalogue analytics on Spark DataFrames."""
