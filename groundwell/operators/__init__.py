"""Operators: each takes DataFrames and returns a DataFrame; none collects its input."""
