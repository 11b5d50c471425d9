"""A property-graph engine on Spark: read-only openCypher compiled to DataFrames, and graph analyses."""

from quiver.api import Catalog, query
from quiver.sources.graph import PropertyGraph

__all__ = ["Catalog", "PropertyGraph", "query"]
