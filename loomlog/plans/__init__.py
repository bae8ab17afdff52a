"""Text commands parsed to requests, and requests compiled to DataFrames."""
