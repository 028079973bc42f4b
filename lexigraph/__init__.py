"""Lexigraph: retrieval, graph, event and text analytics on Spark DataFrames."""
