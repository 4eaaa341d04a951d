"""Scoring worker files as they land."""
