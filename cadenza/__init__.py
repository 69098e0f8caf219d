"""Cadenza: ordered observations to explainable evidence, on Spark DataFrames."""
