"""Tessella: vector-tile analytics on Spark DataFrames."""
