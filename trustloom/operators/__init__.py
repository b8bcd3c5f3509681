"""DataFrame operators: each takes DataFrames and gives a DataFrame."""
