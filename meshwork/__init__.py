"""Meshwork: graph analytics on DataFrames.

Vertices and edges are DataFrames, algorithms are bounded loops of DataFrame
supersteps, and updates are an append-only delta log over immutable Parquet
versions.
"""
