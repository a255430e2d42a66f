"""A durable graph: an append-only log of records as the source of nodes and edges."""
