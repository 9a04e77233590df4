"""Versioned-tree analytics and text-corpus operators on Spark DataFrames."""
