"""Operators over DataFrames: search, keys, profiling, jobs, status, projection."""
