"""Documents into the graph: kinds, normal form, chunks, staging, extraction, schema books."""
