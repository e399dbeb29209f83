"""Ordered text records to tasks, as Spark DataFrames."""
