"""tallyloom: text measurement over time and place on Spark DataFrames."""

__version__ = "0.1.0"
