"""Reconciliation, integrity, hygiene and coverage jobs."""
