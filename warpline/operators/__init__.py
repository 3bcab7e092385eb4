"""Joins, folds, aggregations and rankings of the lineage engine; DataFrames in, DataFrames out."""
