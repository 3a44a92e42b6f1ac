"""Umbra: personal-data detection, governance and accounting on Spark DataFrames."""

__version__ = "0.1.0"
