"""A property-graph query and construction engine that compiles to PySpark DataFrames."""
