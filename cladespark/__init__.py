"""Phylogenetics and alignment analytics on Spark DataFrames."""
