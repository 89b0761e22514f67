"""Retrieval, ranking and text analytics on Spark DataFrames."""
