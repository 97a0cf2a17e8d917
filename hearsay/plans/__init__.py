"""The analyses: each takes DataFrames and returns one result DataFrame."""
