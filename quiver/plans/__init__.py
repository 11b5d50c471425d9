"""Cypher: parser and compiler."""
