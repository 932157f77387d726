"""Tarnloom: code-context retrieval and corpus processing on Spark DataFrames."""
