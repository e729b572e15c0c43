"""Graph operators over edge and vertex DataFrames."""
