"""Terrain and catchment analytics on Spark DataFrames."""
