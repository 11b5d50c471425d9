"""Graphs from tables, Parquet snapshots, resources."""
