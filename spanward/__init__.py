"""Text privacy, gateway analytics and span evaluation on Spark DataFrames."""

__version__ = "0.1.0"
