"""Where nodes and edges come from."""
