"""Distributed e-commerce analytics on PySpark DataFrames."""
