"""Thermal-event analytics on Spark DataFrames."""
