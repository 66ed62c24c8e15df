"""Spark analytics for barcoded short reads: every operator maps DataFrames to DataFrames."""
