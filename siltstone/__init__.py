"""Code and document analytics on Spark DataFrames."""
