"""Checked programs as lazy DataFrames."""
