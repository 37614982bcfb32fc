"""Operators beyond plain relational ones: graphs, retrieval, changes, construction."""
