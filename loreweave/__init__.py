"""Code-knowledge analytics on Spark DataFrames and Structured Streaming."""
