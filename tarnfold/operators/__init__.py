"""Operators over DataFrames, one module for each family."""
