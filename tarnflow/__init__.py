"""Incrementally maintained SQL views on Spark DataFrames."""
