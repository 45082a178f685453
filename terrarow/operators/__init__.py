"""Relational and spatial operators on DataFrames."""
