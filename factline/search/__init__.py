"""Keyword, text and vector search."""
