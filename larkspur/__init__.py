"""Larkspur: label-set analytics over a supplied taxonomy, planned as Spark DataFrames."""
