"""Comparable-transaction analytics on Spark DataFrames."""
