"""Operators over features, classes and plates; each takes and returns DataFrames."""
