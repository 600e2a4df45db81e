"""Operators over alignment and pattern DataFrames."""
