"""Operators: one module per subject, DataFrames in, DataFrames out."""
