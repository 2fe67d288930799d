"""Relational and tensor operators on DataFrames."""
