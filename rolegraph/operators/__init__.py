"""Operators beyond single DataFrame calls: reach over cyclic graphs, duplicate candidates, health."""
