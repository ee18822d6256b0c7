"""Veldra: filtered vector search and corpus operators on Spark DataFrames."""
