"""DataFrame operators: each takes DataFrames and returns DataFrames or fitted parameters."""
