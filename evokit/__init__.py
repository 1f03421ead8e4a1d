"""Stimulus-response analytics on Spark DataFrames."""
