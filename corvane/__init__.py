"""Corvane: retrieval, vector maintenance and corpus processing on Spark DataFrames."""
