"""Streaming ingestion of edges: an extension beyond batch loading."""
