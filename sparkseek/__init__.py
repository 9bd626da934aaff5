"""Hybrid search, ranking and evaluation over code and documents as DataFrames."""
