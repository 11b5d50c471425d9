"""Cypher functions as Columns."""
