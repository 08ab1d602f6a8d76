"""Ratings analytics and recommendation on Spark DataFrames."""

__version__ = "0.1.0"
