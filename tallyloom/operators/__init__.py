"""Operators over typed decision data; each takes and returns DataFrames."""
