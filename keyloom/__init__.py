"""Keyed, versioned tables and large-scale data operators on Spark DataFrames."""

__version__ = "0.1.0"
