"""Operators over DataFrames: catalog, chunking, retrieval, rewriting, rendering, evaluation."""
