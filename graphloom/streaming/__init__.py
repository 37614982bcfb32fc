"""Incremental construction of a graph from a stream of chunks."""
