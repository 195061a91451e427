"""DataFrame operators: each takes long tables and returns long tables."""
