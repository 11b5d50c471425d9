"""Entry points: one query on one graph, a catalog of graphs, queries over several, and listings with limits."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.operators import analysis
from quiver.operators.traverse import subgraph
from quiver.plans.compiler import GRAPHS, Compiler
from quiver.sources.graph import PropertyGraph, union_graphs
from quiver.sources.program import Program

#: Default and largest limits of listings of entities, rows of queries, and call sites that an overview looks at; fixed values.
ENTITY_LIMIT, MOST_ENTITIES = 50, 5000
ROW_LIMIT, MOST_ROWS = 1000, 5000
OVERVIEW_CALLS = 100_000


def query(spark: SparkSession, graph: PropertyGraph, text: str, params: dict | None = None, max_rows: int | None = None) -> DataFrame:
    return Compiler(spark, graph, params).run(text, max_rows)


def clamped(limit: int | None, default: int, most: int) -> int:
    return default if limit is None else max(1, min(limit, most))


@dataclass
class Snapshot:
    """A version of a graph. It is let go (uncached) once it is replaced and nobody holds it."""

    graph: PropertyGraph
    version: int
    program: Program | None = None
    held: int = 0
    replaced: bool = False
    closed: bool = False

    def close_if_idle(self) -> None:
        if self.replaced and not self.held and not self.closed:
            self.closed = True
            self.graph.unpersist()


class Catalog:
    """Named, versioned graphs: registering a name again puts a new snapshot in place of the old, which its readers keep until they are done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.snapshots: dict[str, Snapshot] = {}
        self.enrichers: list[Callable[[PropertyGraph], PropertyGraph]] = []

    @property
    def graphs(self) -> dict[str, PropertyGraph]:
        return {n: s.graph for n, s in self.snapshots.items()}

    @property
    def versions(self) -> dict[str, int]:
        return {n: s.version for n, s in self.snapshots.items()}

    def register_enricher(self, fn: Callable[[PropertyGraph], PropertyGraph]) -> None:
        self.enrichers.append(fn)

    def register(self, name: str, graph: PropertyGraph, program: Program | None = None) -> PropertyGraph:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", name):
            raise ValueError(f"{name!r} is not a graph id")
        for fn in self.enrichers:
            graph = fn(graph)
        graph.name = name
        old = self.snapshots.get(name)
        self.snapshots[name] = Snapshot(graph, old.version + 1 if old else 1, program)
        if old:
            old.replaced = True
            old.close_if_idle()
        return graph

    def unload(self, name: str) -> None:
        old = self.snapshots.pop(name)
        old.replaced = True
        old.close_if_idle()

    @contextlib.contextmanager
    def lease(self, name: str) -> Iterator[Snapshot]:
        """The current snapshot, kept until the lease ends, also if the graph is replaced or unloaded meanwhile."""
        s = self.snapshots[name]
        s.held += 1
        try:
            yield s
        finally:
            s.held -= 1
            s.close_if_idle()

    # queries
    def query(self, text: str, names: list[str] | None = None, params: dict | None = None, provenance: bool = True, limit: int | None = None) -> DataFrame:
        """One query over the union of graphs; provenance adds ``graph_ids``, the sorted owners of each row."""
        graph = union_graphs([self.graphs[n] for n in names or sorted(self.graphs)])
        out = Compiler(self.spark, graph, params, provenance).run(text, None if limit is None else clamped(limit, ROW_LIMIT, MOST_ROWS))
        return out.withColumn(GRAPHS, F.array_sort(GRAPHS)).withColumnRenamed(GRAPHS, "graph_ids") if provenance else out

    def fan_out(self, text: str, limit: int = ROW_LIMIT, names: list[str] | None = None) -> DataFrame:
        """The query on each graph by itself: of each graph at most its share of limit, rounded up, and limit in all.

        Rows are taken in the order of their columns, so reruns agree; ``truncated`` tells on each row whether rows were left out.
        """
        names = names or sorted(self.graphs)
        limit = clamped(limit, ROW_LIMIT, MOST_ROWS)
        share, out = -(-limit // max(1, len(names))), None
        for n in names:
            one = query(self.spark, self.graphs[n], text)
            one = one.orderBy(*[F.col(f"`{c}`") for c in one.columns]).limit(share + 1).withColumn("graph_id", F.lit(n))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        columns = [c for c in out.columns if c != "graph_id"]
        # at most share + 1 rows of each graph are left, so their order is settled in one small task
        order = [F.col("graph_id"), *[F.col(f"`{c}`") for c in columns]]
        own = F.row_number().over(Window.partitionBy("graph_id").orderBy(*order[1:]))
        every = out.withColumn("__own", own).withColumn("__more", F.max(F.col("__own") > share).over(Window.partitionBy())).where(F.col("__own") <= share)
        place = F.row_number().over(Window.partitionBy().orderBy(*order))
        every = every.withColumn("__at", place).withColumn("truncated", F.col("__more") | (F.count(F.lit(1)).over(Window.partitionBy()) > limit))
        return every.where(F.col("__at") <= limit).select(*[F.col(f"`{c}`") for c in columns], "graph_id", "truncated")

    def stats(self, names: list[str] | None = None) -> DataFrame:
        """graph_id, nodes, edges, methods, call_sites (the last two by label where no program tables are registered)."""
        out = None
        for n in names or sorted(self.graphs):
            s = self.snapshots[n]
            g, p = s.graph, s.program
            count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
            calls = p.call_sites if p and p.call_sites is not None else g.nodes.get("CallSiteNode", self.spark.range(0))
            methods = p.methods if p and p.methods is not None else self.spark.range(0)
            one = count(g.scan(list(g.nodes), set()), "nodes").crossJoin(count(g.scan_edges(list(g.edges), set()), "edges")).crossJoin(count(methods, "methods")).crossJoin(count(calls, "call_sites")).select(F.lit(n).alias("graph_id"), "*")
            out = one if out is None else out.union(one)
        return out

    # listings
    def node(self, name: str, node_id: int) -> DataFrame:
        """The node with an id: one filter on every label's table, pushed to its scan."""
        g = self.graphs[name]
        return g.scan(list(g.nodes)).where(F.col("id") == node_id)

    def nodes(self, name: str, label: str | None = None, limit: int | None = None) -> DataFrame:
        g = self.graphs[name]
        return g.scan(g.labels(label)).orderBy("id").limit(clamped(limit, ENTITY_LIMIT, MOST_ENTITIES))

    def outgoing(self, name: str, node_id: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self._edges(name, "src", node_id, types, limit)

    def incoming(self, name: str, node_id: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self._edges(name, "dst", node_id, types, limit)

    def _edges(self, name: str, end: str, node_id: int, types: list[str] | None, limit: int | None) -> DataFrame:
        """Every edge at a node; no more than limit, if one is given."""
        g = self.graphs[name]
        rows = g.scan_edges(g.edge_types(types or [])).where(F.col(end) == node_id).orderBy("type", "src", "dst")
        return rows if limit is None else rows.limit(max(0, limit))

    def call_sites(self, name: str, test: Column | None = None, limit: int | None = None) -> DataFrame:
        rows = self._program(name).call_sites
        return (rows if test is None else rows.where(test)).orderBy("id").limit(clamped(limit, ENTITY_LIMIT, MOST_ENTITIES))

    def methods(self, name: str, test: Column | None = None, limit: int | None = None) -> DataFrame:
        return self._program(name).method_slice(clamped(limit, ENTITY_LIMIT, MOST_ENTITIES), test)

    def annotations(self, name: str, class_name: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self._program(name).annotations
        return (rows if class_name is None else rows.where(F.col("class") == class_name)).orderBy("class", "member", "name").limit(clamped(limit, ENTITY_LIMIT, MOST_ENTITIES))

    def endpoints(self, name: str, annotations: DataFrame | None = None) -> DataFrame:
        """Sorted by path, verb and member. annotations: see analysis.endpoints; the program's own by default."""
        return analysis.endpoints(self._program(name).annotations if annotations is None else annotations).orderBy("path", "verb", "class", "member")

    def overview(self, name: str, top: int | None = None, most: int = OVERVIEW_CALLS) -> tuple[DataFrame, DataFrame]:
        """The class overview of the first call sites by id."""
        return analysis.class_overview(self._program(name).call_sites.orderBy("id").limit(most), clamped(top, ENTITY_LIMIT, MOST_ENTITIES))

    def subgraph(self, name: str, node_id: int, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        g = self.graphs[name]
        return subgraph(g.scan_edges(list(g.edges), set()), self.spark.createDataFrame([(node_id,)], "id long"), depth, direction=direction)

    def listing_all(self, kind: str, limit: int | None = None, **kw) -> DataFrame:
        """A listing (nodes, call_sites, methods, annotations) of every graph, the limit dealt over them."""
        names, out = sorted(self.graphs), None
        for n, share in zip(names, spread(clamped(limit, ENTITY_LIMIT, MOST_ENTITIES), len(names)), strict=True):
            if share:
                one = getattr(self, kind)(n, limit=share, **kw).withColumn("graph_id", F.lit(n))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def _program(self, name: str) -> Program:
        found = self.snapshots[name].program
        if found is None:
            raise ValueError(f"graph {name!r} has no program tables")
        return found


def spread(limit: int, parts: int) -> list[int]:
    """limit dealt over parts, the remainder to the first."""
    return [limit // parts + (i < limit % parts) for i in range(parts)]


#: Comparisons of a stand-alone property filter.
_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def property_filter(column: Column, op: str, value: object) -> Column:
    """column op value: = and <> by number where both are numbers, else by text; < > <= >= by number; =~ of the whole text; STARTS WITH, ENDS WITH, CONTAINS.

    Null columns fail every test but <>.
    """
    text, number = column.cast("string"), column.cast("string").try_cast("double")
    as_number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    want = str(value).lower() if isinstance(value, bool) else str(value)
    if op in ("=", "<>"):
        same = F.when(number.isNotNull(), number == as_number).otherwise(text == want) if as_number is not None else text == want
        return F.coalesce(same, F.lit(False)) if op == "=" else ~F.coalesce(same, F.lit(False))
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](number, F.lit(as_number)), F.lit(False)) if as_number is not None else F.lit(False)
    test = {"=~": lambda: text.rlike(f"^(?:{want})$"), "STARTS WITH": lambda: text.startswith(want), "ENDS WITH": lambda: text.endswith(want), "CONTAINS": lambda: text.contains(want)}[op]()
    return F.coalesce(test, F.lit(False))


def as_maps(df: DataFrame) -> DataFrame:
    """df with nodes, relationships and paths (struct columns) as JSON of what they have: a label's own properties, without the others' nulls."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("struct", "array<struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_rows(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as files: json, csv with a header, or text with tabs between columns."""
    flat = as_maps(df)
    if kind == "json":
        flat.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in flat.dtypes]).write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "text":
        flat.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in flat.columns]).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"{kind} is not json, csv or text")


def render_rows(df: DataFrame, limit: int | None = None) -> str:
    """The first rows as text, for a terminal."""
    rows = as_maps(df).limit(clamped(limit, ROW_LIMIT, MOST_ROWS)).collect()
    return "\n".join(["\t".join(df.columns), *["\t".join("" if v is None else str(v) for v in r) for r in rows]])
