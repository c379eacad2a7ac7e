"""Probabilistic sequence typing on Spark DataFrames."""
