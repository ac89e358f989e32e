"""Breakdown graph: edges, crosswalks, cascade and year fallback."""
