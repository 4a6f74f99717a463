"""Whole-table analysis operators on Spark DataFrames."""
