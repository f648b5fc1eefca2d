"""Operators for preparing training data: each takes DataFrames and returns a lazy DataFrame."""
