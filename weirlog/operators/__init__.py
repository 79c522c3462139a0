"""Operators of template mining, each a function from DataFrames to a DataFrame."""
