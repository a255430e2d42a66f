"""Training-data operators: dedup, scoring, packing, scanning and formatting over document tables."""
