"""Queries over the history of graph-shaped data, on Spark."""
