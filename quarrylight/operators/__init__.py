"""Operators over chunk DataFrames: text, vectors, fusion, ranking, evaluation."""
