"""Windowed multiscale time-series analytics on Spark DataFrames."""
