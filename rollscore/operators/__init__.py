"""Operators: table in, table out."""
