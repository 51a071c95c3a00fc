"""Operators for large text corpora: one module per operator, plain Spark DataFrames in and out."""
