"""Extractors: from text files to nodes, edges and diagnostics, as DataFrame operations over files(path, content)."""
