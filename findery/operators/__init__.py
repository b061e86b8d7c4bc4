"""Operators over DataFrames: indexing, scoring, ranking, fusion, sharding, mutation, evaluation."""
