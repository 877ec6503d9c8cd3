"""Operators: each takes DataFrames and returns DataFrames."""
