"""Behaviour analytics, recommendation and search data operators for Spark DataFrames."""
