"""Relational operators of the core; each takes and returns DataFrames."""
