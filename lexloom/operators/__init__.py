"""Operators of the engine on DataFrames."""
