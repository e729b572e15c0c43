"""Readers and writers of graph data."""
