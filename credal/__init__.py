"""Credal: probabilistic record resolution and analytics on Spark DataFrames."""
