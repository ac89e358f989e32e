"""Provenance-first financial facts on Spark DataFrames."""
