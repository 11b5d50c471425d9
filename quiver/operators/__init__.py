"""Traversals and analyses."""
