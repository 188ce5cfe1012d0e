"""Training-data operators: ten corpus components and the queries that run them."""
