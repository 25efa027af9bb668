"""Household-basket analytics on Spark DataFrames."""
