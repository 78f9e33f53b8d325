"""Mobility-contact analytics on Spark DataFrames."""
