"""Relational, statistical and model operators over DataFrames."""
