"""Matrices and logs as DataFrames."""
