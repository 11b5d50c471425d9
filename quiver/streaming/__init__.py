"""Graphs are immutable snapshots, so queries are batch; a stream of edges becomes a new snapshot per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame


def snapshot_sink(stream: DataFrame, catalog, name: str, build, checkpoint: str):
    """Start a query that registers ``build(batch)`` (a PropertyGraph) as the new version of a graph at each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, _: catalog.register(name, build(batch))).option("checkpointLocation", checkpoint).start()
