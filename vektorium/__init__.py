"""Vektorium: dense-vector analytics on Spark DataFrames."""
