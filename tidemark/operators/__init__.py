"""Relational, temporal and sequence operators; each takes and returns DataFrames."""
