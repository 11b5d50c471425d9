"""Property graphs as DataFrames: one node table for each label, one edge table for each type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EdgeTable:
    """frame: src, dst and properties; source and target: the labels of the ends, if known (then joins to them can be saved).

    ended: frame with the labels of both ends on every row (__from, __to), where edges of one type end at several. Ids need only differ within a
    label where the labels of the ends are known.
    """

    frame: DataFrame
    source: str | None = None
    target: str | None = None
    ended: DataFrame | None = None


@dataclass
class PropertyGraph:
    """nodes: label -> frame (id, properties). edges: type -> EdgeTable. aliases: other spelling -> labels it covers."""

    nodes: dict[str, DataFrame]
    edges: dict[str, EdgeTable]
    name: str = "main"
    aliases: dict[str, list[str]] = field(default_factory=dict)

    def labels(self, wanted: str | None) -> list[str]:
        """Labels that a spelling covers (case does not matter); an unknown one covers every label."""
        if wanted is None:
            return list(self.nodes)
        low = wanted.lower()
        found = [x for x in self.nodes if x.lower() == low] + [y for k, v in self.aliases.items() if k.lower() == low for y in v if y in self.nodes]
        return found or list(self.nodes)

    def scan(self, labels: list[str], needed: set[str] | None = None) -> DataFrame:
        """id, graph_id, label and properties of the labels' nodes; conflicting types become strings."""
        return _union([(self.nodes[x], {"label": F.lit(x), "graph_id": _graph(self.nodes[x], self.name)}) for x in labels], {"id", "graph_id", "label"} | needed if needed is not None else None)

    def edge_types(self, wanted: list[str]) -> list[str]:
        low = {w.lower() for w in wanted}
        if not low:
            return list(self.edges)
        return [t for t in self.edges if t.lower() in low or "resource" in low and t.lower().startswith("resource_")]

    def scan_edges(self, types: list[str], needed: set[str] | None = None, ends: bool = False) -> DataFrame:
        """src, dst, graph_id, type and properties; with ends also __from and __to, the labels of the ends or null."""
        parts = []
        for t in types:
            e = self.edges[t]
            df, more = e.frame, {"type": F.lit(t), "graph_id": _graph(e.frame, self.name)}
            if ends and e.ended is not None:
                df, more = e.ended, more | {k: F.col(k) for k in ("__from", "__to")}
            elif ends:
                more |= {k: F.lit(x if x in self.nodes else None).cast("string") for k, x in (("__from", e.source), ("__to", e.target))}
            parts.append((df, more))
        return _union(parts, {"src", "dst", "graph_id", "type"} | needed if needed is not None else None)

    def knows_ends(self, kind: str) -> tuple[bool, bool]:
        """Whether edges of a type come with the labels of their sources and of their targets."""
        e = self.edges[kind]
        return (True, True) if e.ended is not None else (e.source in self.nodes, e.target in self.nodes)

    def save(self, folder: str) -> None:
        """A folder of Parquet for each label and type, and a manifest that names them."""
        spark = next(iter([*self.nodes.values(), *[e.frame for e in self.edges.values()]])).sparkSession
        for label, df in self.nodes.items():
            df.write.mode("overwrite").parquet(f"{folder}/nodes/label={label}")
        for kind, e in self.edges.items():
            (e.frame if e.ended is None else e.ended).write.mode("overwrite").parquet(f"{folder}/edges/type={kind}")
        rows = [("node", x, None, None, None) for x in self.nodes] + [("edge", t, e.source, e.target, None) for t, e in self.edges.items()] + [("alias", k, None, None, v) for k, v in self.aliases.items()]
        spark.createDataFrame(rows, "kind string, name string, source string, target string, covers array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")

    @staticmethod
    def load(spark: SparkSession, folder: str, labels: list[str] | None = None, types: list[str] | None = None, name: str = "main", mode: str = "mapped") -> PropertyGraph:
        """The graph of a folder, or some labels and types of it. mode: mapped reads what a query needs; eager keeps it in the executors' memory."""
        if mode not in ("mapped", "eager"):
            raise ValueError(f"{mode} is not mapped or eager")
        rows = spark.read.parquet(f"{folder}/manifest").collect()
        ends = {r["name"]: (r["source"], r["target"]) for r in rows if r["kind"] == "edge"}
        read = lambda path: spark.read.parquet(path).cache() if mode == "eager" else spark.read.parquet(path)
        nodes = {r["name"]: read(f"{folder}/nodes/label={r['name']}") for r in rows if r["kind"] == "node" and (labels is None or r["name"] in labels)}
        edges = {t: _edge_table(read(f"{folder}/edges/type={t}"), *ends[t]) for t in ends if types is None or t in types}
        return PropertyGraph(nodes, edges, name, {r["name"]: r["covers"] for r in rows if r["kind"] == "alias"})

    def unpersist(self) -> None:
        for df in [*self.nodes.values(), *[x for e in self.edges.values() for x in (e.frame, e.ended) if x is not None]]:
            df.unpersist()


def _edge_table(df: DataFrame, source: str | None = None, target: str | None = None) -> EdgeTable:
    """The table of edges df, which may have the labels of its ends."""
    return EdgeTable(df.drop("__from", "__to"), source, target, df) if "__from" in df.columns else EdgeTable(df, source, target)


def _graph(df: DataFrame, name: str):
    return F.col("graph_id") if "graph_id" in df.columns else F.lit(name)


def _union(parts: list[tuple[DataFrame, dict]], keep: set[str] | None) -> DataFrame:
    kinds: dict[str, set[str]] = {}
    for df, _ in parts:
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    out = None
    for df, extra in parts:
        columns = [F.col(c).cast("string").alias(c) if len(kinds[c]) > 1 else F.col(c) for c in df.columns if c not in extra and (keep is None or c in keep)]
        one = df.select(*columns, *[v.alias(k) for k, v in extra.items()])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def union_graphs(graphs: list[PropertyGraph], name: str = "all") -> PropertyGraph:
    """One graph over several: rows keep their graph_id, and traversals stay inside a graph."""
    if len({g.name for g in graphs}) != len(graphs):
        raise ValueError("graph names must differ")
    labels = dict.fromkeys(x for g in graphs for x in g.nodes)
    types = dict.fromkeys(t for g in graphs for t in g.edges)
    nodes = {x: _union([(g.nodes[x], {"graph_id": _graph(g.nodes[x], g.name)}) for g in graphs if x in g.nodes], None) for x in labels}
    edges = {}
    for t in types:
        own = [g for g in graphs if t in g.edges]
        ends = {(g.edges[t].source, g.edges[t].target) for g in own}
        source, target = next(iter(ends)) if len(ends) == 1 else (None, None)
        # each graph knows its ends, but not as one label for all
        whole = all(all(g.knows_ends(t)) for g in own) and (len(ends) > 1 or any(g.edges[t].ended is not None for g in own))
        frames = [(g.scan_edges([t], ends=True).drop("type") if whole else g.edges[t].frame, g) for g in own]
        edges[t] = _edge_table(_union([(df, {"graph_id": _graph(df, g.name)}) for df, g in frames], None), source, target)
    return PropertyGraph(nodes, edges, name, {k: v for g in graphs for k, v in g.aliases.items()})


def collapse_parallel_edges(edges: DataFrame, order: str) -> DataFrame:
    """Of the edges between two nodes, the last by order."""
    w = Window.partitionBy("src", "dst").orderBy(F.col(order).desc())
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Node ids are an offset and a key. On large tables ids of different labels meet, so a node is known by label and id.
OFFSETS = {"Region": 1_000_000, "Nation": 2_000_000, "Customer": 3_000_000, "Supplier": 4_000_000, "Part": 5_000_000, "Order": 6_000_000, "Event": 8_000_000}


def from_tables(spark: SparkSession, folder: str, name: str = "main") -> PropertyGraph:
    """The star schema as a graph; lineitem rows are edges, parallel ones included."""
    t = lambda x: spark.read.parquet(f"{folder}/{x}.parquet")
    at = lambda label, key: (F.col(key).cast("long") + OFFSETS[label])
    nodes = {
        "Region": t("region").select(at("Region", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Nation": t("nation").select(at("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Customer": t("customer").select(at("Customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        "Supplier": t("supplier").select(at("Supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        "Part": t("part").select(at("Part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice")),
        "Order": t("orders").select(at("Order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").alias("orderdate"), F.col("o_orderpriority").alias("priority")),
        "Event": t("events").select(at("Event", "event_id").alias("id"), "ts", F.col("user_id").alias("user"), F.col("event_type").alias("kind"), "value"),
    }
    line = t("lineitem")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    props = [F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag")]
    living = t("customer").select(at("Customer", "c_custkey").alias("src"), at("Nation", "c_nationkey").alias("dst"), F.lit("Customer").alias("__from"), F.lit("Nation").alias("__to")).union(t("supplier").select(at("Supplier", "s_suppkey"), at("Nation", "s_nationkey"), F.lit("Supplier"), F.lit("Nation")))
    edges = {
        "IN_REGION": EdgeTable(t("nation").select(at("Nation", "n_nationkey").alias("src"), at("Region", "n_regionkey").alias("dst")), "Nation", "Region"),
        "IN_NATION": _edge_table(living, None, "Nation"),
        "PLACED": EdgeTable(t("orders").select(at("Customer", "o_custkey").alias("src"), at("Order", "o_orderkey").alias("dst")), "Customer", "Order"),
        "CONTAINS": EdgeTable(line.select(at("Order", "l_orderkey").alias("src"), at("Part", "l_partkey").alias("dst"), *props), "Order", "Part"),
        "SUPPLIED_BY": EdgeTable(line.select(at("Part", "l_partkey").alias("src"), at("Supplier", "l_suppkey").alias("dst"), *props), "Part", "Supplier"),
        "NEXT": EdgeTable(t("events").select(at("Event", "event_id").alias("src"), (after.cast("long") + OFFSETS["Event"]).alias("dst")).where("dst is not null"), "Event", "Event"),
    }
    return PropertyGraph(nodes, edges, name)
