"""Grounded-retrieval analytics as Spark DataFrames."""
