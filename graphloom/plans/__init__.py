"""Model programs, training and the query registry."""
