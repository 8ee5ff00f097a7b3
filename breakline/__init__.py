"""Change-point detection over many ordered series, and training-data operators, on Spark DataFrames."""

__version__ = "0.1.0"
