"""Graph neural analytics on Spark: graphs are edge and vertex DataFrames."""
