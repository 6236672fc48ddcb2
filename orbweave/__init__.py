"""Trajectory-network analytics on Spark DataFrames."""
