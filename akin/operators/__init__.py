"""Scorers, searches, indexes, batches and edit scripts over DataFrames."""
