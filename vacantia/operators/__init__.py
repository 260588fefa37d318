"""Operators over DataFrames: timestamps, records, search, identity."""
