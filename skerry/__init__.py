"""Vault analytics on Spark DataFrames."""
