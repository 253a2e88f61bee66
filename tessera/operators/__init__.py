"""Bound plans as DataFrames: expressions and the five relational operators."""
