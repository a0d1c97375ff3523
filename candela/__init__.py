"""Candela: ranking analytics on Spark DataFrames."""
