"""Cypher clauses as DataFrame transformations.

A node or relationship variable ``n`` is a set of flat columns ``n__id``, ``n__label``, ``n__<property>``, so that Catalyst
prunes and pushes down as for any table; only properties that the query reads are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions.scalar import MATH, SCALARS, aggregate
from quiver.operators.traverse import expand, expand_paths
from quiver.plans.parser import AGGREGATES, Clause, CypherError, EdgePattern, Item, NodePattern, Path, has_aggregate, parse, render, used
from quiver.sources.graph import PropertyGraph

GRAPHS = "__graphs"
#: How many matches a row stands for, where rows were folded.
WEIGHT = "__weight"


@dataclass
class Var:
    kind: str  # node, edge, walk, path, value
    columns: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    turned: bool = False  # a path that was matched from its end


class Compiler:
    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict | None = None, provenance: bool = False) -> None:
        self.spark, self.graph, self.params, self.provenance = spark, graph, params or {}, provenance
        self.count = 0

    # queries
    def run(self, text: str, max_rows: int | None = None) -> DataFrame:
        out = None
        for statement in parse(text):
            out = self.statement(statement)
        return out if max_rows is None else out.limit(max_rows)

    def statement(self, clauses: list[Clause]) -> DataFrame:
        parts: list[list[Clause]] = [[]]
        last_all = False
        for c in clauses:
            if c.kind == "union":
                last_all = c.all
                parts.append([])
            else:
                parts[-1].append(c)
        frames = [self.single(p) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            if [c for c in f.columns if c != GRAPHS] != [c for c in out.columns if c != GRAPHS]:
                raise CypherError("the parts of a UNION must have the same columns")
            out = out.unionByName(f)
        return self.unique(out) if len(frames) > 1 and not last_all else out

    def single(self, clauses: list[Clause]) -> DataFrame:
        self.needs: dict[str, set[str] | None] = {}
        star = any(c.star for c in clauses)
        for c in clauses:
            for path in c.paths:
                for x in [*path.nodes, *path.edges]:
                    for e in x.props.values():
                        used(e, self.needs)
                    if x.var:
                        for k in x.props:
                            if self.needs.get(x.var, set()) is not None:
                                self.needs.setdefault(x.var, set()).add(k)
            for e in [c.where, c.skip, c.limit, c.expr, *[o for o, _ in c.order]]:
                if e is not None:
                    used(e, self.needs)
            for item in c.items:
                # a variable that WITH only hands on needs no more than its later uses
                if not (c.kind == "with" and item.expr[0] == "var" and item.expr[1] == item.name):
                    used(item.expr, self.needs)
        if star:
            self.needs = {x.var: None for c in clauses for p in c.paths for x in [*p.nodes, *p.edges] if x.var} | {k: None for k in self.needs}
        df, env = self.spark.range(1).select(F.lit(1).alias("__one")), {}
        if self.provenance:
            df = df.withColumn(GRAPHS, F.array().cast("array<string>"))
        live, begins = None, True
        for k, c in enumerate(clauses):
            if begins:
                end = next((i for i in range(k, len(clauses)) if clauses[i].kind in ("with", "return")), k)
                only_counts = not self.provenance and counts_only(clauses[end])
            begins = c.kind in ("with", "return")
            live = set().union(*[reads(x) for x in clauses[k + 1 : end + 1]]) if only_counts else None
            df, env = self.do_match(df, env, c, live) if c.kind == "match" else getattr(self, c.kind)(df, env, c)
        return df

    def fresh(self) -> str:
        self.count += 1
        return f"__a{self.count}"

    # matching
    def do_match(self, df: DataFrame, env: dict, c: Clause, live: set[str] | None = None):
        """live: what is read after the clause, where rows may be folded."""
        for k, p in enumerate(c.paths):
            later = None if live is None else live.union(_variables(c.where or ()), *[path_reads(x) for x in c.paths[k + 1 :]])
            if later is not None:
                df, env = self.folded(df, env, later | path_reads(p))
            df, env = self.path(df, env, p, later)
        return (df.where(self.holds(c.where, env, df)) if c.where else df), env

    def folded(self, df: DataFrame, env: dict, live: set[str]):
        """Before rows are multiplied: one row for those that agree in all that is read later, and how many they are, so that matches are counted, not made."""
        live = live | {x for v in live if v in env for x in env[v].parts}
        kept = {v: x for v, x in env.items() if v in live}
        columns = list(dict.fromkeys(c for x in kept.values() for c in x.columns))
        # maps are no keys, and floating-point keys lose the sign of zero
        if len(kept) == len(env) or any(x in t for c, t in df.dtypes if c in columns for x in ("float", "double", "map", "variant")):
            return df, env
        n = F.sum(WEIGHT) if WEIGHT in df.columns else F.count(F.lit(1))
        return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(n.alias(WEIGHT)).where(F.col(WEIGHT) > 0), kept

    def optional(self, df: DataFrame, env: dict, c: Clause):
        """Matches for the distinct bound values, joined back to all rows."""
        seen: dict[str, set | None] = {}
        for p in c.paths:
            for x in [*p.nodes, *p.edges]:
                if x.var:
                    seen[x.var] = None
                used(tuple(x.props.values()), seen)
        if c.where:
            used(c.where, seen)
        bound = [v for v in env if v in seen]
        keys = [k for v in bound for k in env[v].columns]
        left_env = {v: env[v] for v in bound}
        start = df.select(*[F.col(k) for k in keys]).distinct() if keys else self.spark.range(1).select(F.lit(1).alias("__one"))
        if self.provenance:
            start = start.withColumn(GRAPHS, F.array().cast("array<string>"))
        found, new = self.do_match(start, left_env, c)
        renamed = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(k) for v in new if v not in env for k in new[v].columns], *[F.col(GRAPHS).alias("__found")] * self.provenance)
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
            on = same if on is None else on & same
        out = df.join(renamed, on if on is not None else F.lit(True), "left").drop(*[f"__k_{k}" for k in keys])
        if self.provenance:
            out = out.withColumn(GRAPHS, F.array_union(GRAPHS, F.coalesce("__found", F.array().cast("array<string>")))).drop("__found")
        return out, env | {v: x for v, x in new.items() if v not in env}

    def path(self, df: DataFrame, env: dict, p: Path, later: set[str] | None = None):
        nodes, edges = p.nodes, p.edges
        # begin where something is bound; what a variable length gives depends on the end that it begins at
        if not (nodes[0].var in env) and nodes[-1].var in env and not any(e.variable_length for e in edges):
            turn = {"out": "in", "in": "out", "both": "both"}
            nodes = nodes[::-1]
            edges = [EdgePattern(e.var, e.types, e.props, turn[e.direction], e.low, e.high) for e in edges[::-1]]
        names = [n.var or self.fresh() for n in nodes]
        links = [e.var or self.fresh() for e in edges]
        whole = p.var is not None and p.var in self.needs and self.needs[p.var] is None
        if p.var:
            for n in names + links:
                self.needs.setdefault(n, set())
        df, env = self.node(df, env, nodes[0], names[0], self.ends(edges[0], False) if edges and not edges[0].variable_length else None)
        for k, (e, link, n, a, b) in enumerate(zip(edges, links, nodes[1:], names, names[1:], strict=False)):
            if k and later is not None and not p.var and e.direction != edges[k - 1].direction:
                # what led to one node meets what leads away from it
                df, env = self.folded(df, env, later.union(names[k:], links[k:], *[_variables(tuple(x.props.values())) for x in [*nodes[k:], *edges[k:]]]))
            df, env = self.hop(df, env, e, link, a, n, b, whole)
        if p.var:
            ordered = [x for pair in zip(names, [*links, None], strict=True) for x in pair if x]
            env = env | {p.var: Var("path", [c for x in ordered for c in env[x].columns], ordered if nodes is p.nodes else ordered[::-1], nodes is not p.nodes)}
        return df, env

    def labels_of(self, pattern: NodePattern) -> list[str]:
        found = self.graph.labels(pattern.labels[0] if pattern.labels else None)
        for x in pattern.labels[1:]:
            more = set(self.graph.labels(x))
            found = [y for y in found if y in more]
        return found

    def scan(self, labels: list[str], name: str, pattern: NodePattern) -> DataFrame:
        needs = self.needs.get(name, set())
        needs = None if needs is None else needs | set(pattern.props)
        t = self.graph.scan(labels or list(self.graph.nodes)[:1], needs)
        if not labels:
            t = t.where(F.lit(False))
        return t.select(*[F.col(c).alias(f"{name}__{c}") for c in t.columns])

    def among(self, t: DataFrame, name: str, ends: set[str | None] | None) -> DataFrame:
        """Nodes that edges with these ends can meet: other labels' tables are not read."""
        return t if not ends or None in ends else t.where(F.col(f"{name}__label").isin(sorted(ends)))

    def inline(self, df: DataFrame, env: dict, name: str, props: dict) -> DataFrame:
        for k, e in props.items():
            df = df.where(self.equal(self.property(name, k, env), self.expr(e, env, df)))
        return df

    def seen_graph(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(GRAPHS, F.array_union(GRAPHS, F.array(f"{name}__graph_id"))) if self.provenance else df

    def ends(self, e: EdgePattern, far: bool) -> set[str | None]:
        """Labels that the near or far ends of an edge pattern can have; with None, others too."""
        sides = {"out": (far,), "in": (not far,), "both": (False, True)}[e.direction]
        tables = [self.graph.edges[t] for t in self.graph.edge_types(e.types)]
        return {x if x in self.graph.nodes else None for t in tables for side in sides for x in [t.target if side else t.source]}

    def meets(self, name: str, link: str, e: EdgePattern, far: bool) -> Column:
        """Whether node name is the near or far end of link: by id, graph and, where the edges tell it, label, as ids of different labels may meet."""
        on = (F.col(f"{name}__id") == F.col(f"{link}__{'dst' if far else 'src'}")) & (F.col(f"{name}__graph_id") == F.col(f"{link}__graph_id"))
        sides = {"out": (far,), "in": (not far,), "both": (False, True)}[e.direction]
        known = {self.graph.knows_ends(t)[side] for t in self.graph.edge_types(e.types) for side in sides}
        if e.variable_length:
            known = {self.labelled(e)}
        label = F.col(f"{link}____{'to' if far else 'from'}")
        same = F.col(f"{name}__label") == label
        return on & same if known == {True} else on & (label.isNull() | same) if True in known else on

    def labelled(self, e: EdgePattern) -> bool:
        """Whether both ends of every edge are known by label, as a walk needs them that keeps labels apart."""
        return all(all(self.graph.knows_ends(t)) for t in self.graph.edge_types(e.types))

    def node(self, df: DataFrame, env: dict, pattern: NodePattern, name: str, ends: set[str | None] | None = None):
        if name in env:
            if pattern.labels:
                df = df.where(F.col(f"{name}__label").isin(self.labels_of(pattern)))
            return self.inline(df, env, name, pattern.props), env
        t = self.among(self.scan(self.labels_of(pattern), name, pattern), name, ends)
        alone = not [v for v in env.values() if v.columns]
        own = {name: Var("node", t.columns)}
        free = all(not _variables(e) for e in pattern.props.values())
        t = self.inline(t, own, name, pattern.props) if free else t
        df = t.select("*", *[F.array().cast("array<string>").alias(GRAPHS)] * self.provenance, F.lit(1).alias("__one")) if alone and "__one" in df.columns else df.crossJoin(t)
        env = env | own
        return self.seen_graph(df if free else self.inline(df, env, name, pattern.props), name), env

    def oriented(self, e: EdgePattern, needs: set[str] | None) -> DataFrame:
        types = self.graph.edge_types(e.types)
        t = self.graph.scan_edges(types or list(self.graph.edges)[:1], needs, ends=True)
        if not types:
            t = t.where(F.lit(False))
        turn = {"src": "dst", "dst": "src", "__from": "__to", "__to": "__from"}
        back = t.select(*[F.col(turn.get(c, c)).alias(c) for c in t.columns])
        return t if e.direction == "out" else back if e.direction == "in" else t.unionByName(back)

    def hop(self, df: DataFrame, env: dict, e: EdgePattern, link: str, a: str, n: NodePattern, b: str, whole: bool = False):
        if e.variable_length:
            return self.walk(df, env, e, link, a, n, b, whole)
        needs = self.needs.get(link, set())
        t = self.oriented(e, None if needs is None else needs | set(e.props))
        t = t.select(*[F.col(c).alias(f"{link}__{c}") for c in t.columns])
        if link in env:
            raise CypherError(f"relationship {link} is bound twice")
        own = {link: Var("edge", [c for c in t.columns if c not in (f"{link}____from", f"{link}____to")])}
        free = all(not _variables(x) for x in e.props.values())
        t = self.inline(t, own, link, e.props) if free else t
        on = self.meets(a, link, e, False)
        if b in env:
            on = on & self.meets(b, link, e, True)
        df = df.join(t, on)
        env = env | own
        if not free:
            df = self.inline(df, env, link, e.props)
        return self.reach(df, env, n, b, link, e)

    def reach(self, df: DataFrame, env: dict, n: NodePattern, b: str, link: str, e: EdgePattern):
        """Bind the node that an edge or a walk leads to."""
        if b in env:
            return self.node(df, env, n, b)
        labels, ends = self.labels_of(n), None
        if not e.variable_length:
            ends = self.ends(e, True)
            if not n.props and self.needs.get(b, set()) == set() and ends and None not in ends and ends <= set(labels):
                # the edge table says what it leads to, and nothing else of the node is read
                made = {"id": F.col(f"{link}__dst"), "label": F.lit(next(iter(ends))) if len(ends) == 1 else F.col(f"{link}____to"), "graph_id": F.col(f"{link}__graph_id")}
                df = df.select("*", *[c.alias(f"{b}__{k}") for k, c in made.items()])
                return self.seen_graph(df, b), env | {b: Var("node", [f"{b}__{k}" for k in made])}
        t = self.among(self.scan(labels, b, n), b, ends)
        own = {b: Var("node", t.columns)}
        free = all(not _variables(x) for x in n.props.values())
        t = self.inline(t, own, b, n.props) if free else t
        df = df.join(t, self.meets(b, link, e, True))
        env = env | own
        return self.seen_graph(df if free else self.inline(df, env, b, n.props), b), env

    def walk(self, df: DataFrame, env: dict, e: EdgePattern, link: str, a: str, n: NodePattern, b: str, whole: bool):
        """Expansion from the distinct starts, then a join back: wide rows never enter the loop. whole: paths are read, so they are carried."""
        t = self.oriented(e, set(e.props))
        for k, x in e.props.items():
            t = t.where(F.col(k) == self.expr(x, {}, t))
        apart = self.labelled(e)
        key = lambda g, i, label: F.struct(F.col(g).alias("g"), F.col(i).alias("i"), *[F.col(label).alias("l")] * apart)
        steps = t.select(key("graph_id", "src", "__from").alias("src"), key("graph_id", "dst", "__to").alias("dst"), *[F.col("type")] * whole)
        seeds = df.select(key(f"{a}__graph_id", f"{a}__id", f"{a}__label").alias("id")).where("id.i is not null").distinct()
        if whole:
            at = self.graph.scan(list(self.graph.nodes), set()).select(key("graph_id", "id", "label").alias("dst"), "label")
            got = expand_paths(steps.join(at, "dst"), seeds, e.low, e.high, F.struct(F.col("src.i").alias("src"), F.col("dst.i").alias("dst"), "type", "label"))
        else:
            got = expand(steps, seeds, e.low, e.high)
        got = got.select(F.col("s.g").alias(f"{link}__graph_id"), F.col("s.i").alias(f"{link}__src"), F.col("v.i").alias(f"{link}__dst"), F.col("depth").alias(f"{link}__depth"), *[F.col("path").alias(f"{link}__path")] * whole, *[F.col(f"{x}.l").alias(f"{link}____{y}") for x, y in (("s", "from"), ("v", "to"))] * apart)
        df = df.join(got, self.meets(a, link, e, False))
        env = env | {link: Var("walk", [c for c in got.columns if c not in (f"{link}____from", f"{link}____to")])}
        if b in env:
            df = df.where(self.meets(b, link, e, True))
        return self.reach(df, env, n, b, link, e)

    # rows
    def unwind(self, df: DataFrame, env: dict, c: Clause):
        x = self.expr(c.expr, env, df)
        if not df.select(x).dtypes[0][1].startswith("array"):
            # null or a single value gives no row
            x = F.array().cast("array<string>")
        return df.withColumn(c.var, F.explode(x)), env | {c.var: Var("value", [c.var])}

    def unique(self, df: DataFrame) -> DataFrame:
        if not self.provenance:
            return df.distinct()
        rest = [c for c in df.columns if c != GRAPHS]
        return df.groupBy(*[F.col(f"`{c}`") for c in rest]).agg(self.merged())

    def merged(self) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(GRAPHS)))).alias(GRAPHS)

    def returned(self, name: str, env: dict) -> Column:
        v = env[name]
        if v.kind == "value":
            return F.col(f"`{name}`")
        if v.kind == "path":
            return F.struct(self.path_nodes(v, env).alias("nodes"), self.path_edges(v, env).alias("relationships"))
        return F.struct(*[F.col(c).alias(c.split("__", 1)[1] if not c.startswith("__") else c[2:].split("__", 1)[1]) for c in v.columns if c != f"{name}__graph_id"])

    def path_nodes(self, v: Var, env: dict) -> Column:
        parts, before = [], None
        for x in v.parts:
            if env[x].kind == "node":
                one = F.array(F.struct(F.col(f"{x}__id").alias("id"), F.col(f"{x}__label").alias("label")))
                # both ends of a way of length 0 are one node
                parts.append(one if before is None else F.when(F.col(f"{before}__depth") > 0, one).otherwise(F.slice(one, 1, 0)))
            elif env[x].kind == "walk":
                # the nodes between its ends
                inner = F.transform(F.slice(f"{x}__path", F.lit(1), F.greatest(F.size(f"{x}__path") - 1, F.lit(0))), lambda s: F.struct(s["dst"].alias("id"), s["label"].alias("label")))
                parts.append(F.reverse(inner) if v.turned else inner)
            before = x if env[x].kind == "walk" else None
        return F.concat(*parts)

    def path_edges(self, v: Var, env: dict) -> Column:
        parts = []
        for x in v.parts:
            if env[x].kind == "edge":
                parts.append(F.array(F.struct(F.col(f"{x}__src").alias("src"), F.col(f"{x}__dst").alias("dst"), F.col(f"{x}__type").alias("type"))))
            elif env[x].kind == "walk":
                steps = F.transform(F.col(f"{x}__path"), lambda s: F.struct(s["src"].alias("src"), s["dst"].alias("dst"), s["type"].alias("type")))
                parts.append(F.reverse(steps) if v.turned else steps)
        return F.concat(*parts) if parts else F.array().cast("array<struct<src:bigint,dst:bigint,type:string>>")

    def project(self, df: DataFrame, env: dict, c: Clause, final: bool):
        items = [Item(("var", v), v) for v in env if not v.startswith("__")] * c.star + c.items
        grouped = any(has_aggregate(i.expr) for i in items)
        made: list[tuple[str, Column]] = []
        keys: list[str] = []
        self.before: dict[str, Column] = {}
        out_env: dict[str, Var] = {}
        for item in items:
            e = item.expr
            if e[0] == "var" and e[1] in env and env[e[1]].kind != "value" and not final:
                v = env[e[1]]
                columns = [k.replace(f"{e[1]}__", f"{item.name}__", 1) if v.kind != "path" else k for k in v.columns]
                made += [(k, F.col(f"`{old}`")) for k, old in zip(columns, v.columns, strict=True)]
                keys += columns
                out_env[item.name] = Var(v.kind, columns, v.parts)
                if v.kind == "path":
                    out_env |= {x: env[x] for x in v.parts}
            else:
                made.append((item.name, self.returned(e[1], env) if e[0] == "var" and e[1] in env else self.expr(e, env, df)))
                if not has_aggregate(e):
                    keys.append(item.name)
                out_env[item.name] = Var("value", [item.name])
        made = list({k: (k, x) for k, x in made}.values())
        hidden: list[str] = []
        sort = []
        for k, (e, down) in enumerate(c.order):
            same = next((i.name for i in items if (i.expr == e or e == ("var", i.name)) and out_env[i.name].kind == "value"), None)
            if same is not None:
                sort.append((F.col(f"`{same}`"), down))
            else:
                h = f"__s{k}"
                made.append((h, self.expr(e, {**env, **{x: y for x, y in out_env.items() if x not in env}}, df)))
                if not has_aggregate(e):
                    keys.append(h)
                hidden.append(h)
                sort.append((F.col(h), down))
        if grouped:
            df = df.withColumns(self.before) if self.before else df
            agg = [x.alias(k) for k, x in made if k not in keys] + [self.merged()] * self.provenance
            named = [x.alias(k) for k, x in made if k in keys]
            out = df.groupBy(*named).agg(*agg) if agg else df.groupBy(*named).count().drop("count")
            out = out.select(*[F.col(f"`{k}`") for k, _ in made], *[F.col(GRAPHS)] * self.provenance)
        else:
            out = df.select(*[x.alias(k) for k, x in made], *[F.col(GRAPHS)] * self.provenance)
        if c.distinct:
            out = self.unique(out)
        if c.where:
            out = out.where(self.holds(c.where, out_env, out))
        if sort:
            out = out.orderBy(*[x.desc_nulls_last() if down else x.asc_nulls_first() for x, down in sort])
        skip, limit = (self.number(x) for x in (c.skip, c.limit))
        if skip:
            out = out.offset(skip)
        if limit is not None:
            out = out.limit(limit)
        return out.drop(*hidden), out_env

    def number(self, e: tuple | None) -> int | None:
        if e is None:
            return None
        v = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else None
        return max(0, int(v)) if isinstance(v, (int, float)) else 0

    def with_(self, df, env, c):
        return self.project(df, env, c, False)

    def return_(self, df, env, c):
        return self.project(df, env, c, True)

    # expressions
    def property(self, name: str, key: str, env: dict) -> Column:
        v = env[name]
        if key in ("elementId", "qualifiedId"):
            return F.concat_ws(":", f"{name}__graph_id", F.col(f"{name}__id").cast("string"))
        if key == "graphId":
            return F.col(f"{name}__graph_id")
        if v.kind == "path" and key == "length":
            return self.length(v, env)
        if f"{name}__{key}" in v.columns:
            return F.col(f"{name}__{key}")
        return F.col(f"{name}__label") if key == "type" and v.kind == "node" else F.lit(None).cast("string")

    def length(self, v: Var, env: dict) -> Column:
        out = F.lit(0)
        for x in v.parts:
            out = out + (F.col(f"{x}__depth") if env[x].kind == "walk" else F.lit(1 if env[x].kind == "edge" else 0))
        return out

    def equal(self, a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    def holds(self, e: tuple, env: dict, df: DataFrame) -> Column:
        """A condition of which only true survives: there null equals null, which stays a key that joins can hash."""
        if e[0] == "op" and e[1] in ("and", "or"):
            a, b = self.holds(e[2], env, df), self.holds(e[3], env, df)
            return a & b if e[1] == "and" else a | b
        if e[0] == "op" and e[1] == "=" and "lit" not in (e[2][0], e[3][0]):
            a, b = self.alike(self.expr(e[2], env, df), self.expr(e[3], env, df), e, df, {})
            return a.eqNullSafe(b)
        return self.expr(e, env, df).cast("boolean")

    def alike(self, a: Column, b: Column, e: tuple, df: DataFrame, local: dict) -> tuple[Column, Column]:
        """Both as strings, where one is a string and the other is not."""
        ka, kb = self.kind(a, df, e[2], local), self.kind(b, df, e[3], local)
        mixed = "void" not in (ka, kb) and "unknown" not in (ka, kb) and (ka == "string") != (kb == "string")
        return (a.cast("string"), b.cast("string")) if mixed else (a, b)

    def kind(self, c: Column, df: DataFrame, e: tuple, local: dict) -> str:
        """The type of c; unknown where it depends on a variable of a list expression, which no frame can resolve."""
        return "unknown" if set(local) & _variables(e) else df.select(c).dtypes[0][1]

    def expr(self, e: tuple, env: dict, df: DataFrame, local: dict | None = None) -> Column:
        local = local or {}
        go = lambda x: self.expr(x, env, df, local)
        k = e[0]
        if k == "lit":
            return F.lit(e[1])
        if k == "param":
            return F.lit(self.params.get(e[1]))
        if k == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] not in env:
                raise CypherError(f"{e[1]} is not defined")
            return F.col(f"`{e[1]}`") if env[e[1]].kind == "value" else F.col(f"{e[1]}__id") if env[e[1]].kind == "node" else self.returned(e[1], env)
        if k == "prop":
            if e[1][0] == "var" and e[1][1] in env and e[1][1] not in local and env[e[1][1]].kind != "value":
                return self.property(e[1][1], e[2], env)
            base = go(e[1])
            kind = self.kind(base, df, e[1], local)
            if kind == "unknown" or kind.startswith("map"):
                return base.getItem(e[2])
            return base.getField(e[2]) if f"<{e[2]}:" in kind or f",{e[2]}:" in kind else F.lit(None).cast("string")
        if k == "list":
            return F.array(*[go(x) for x in e[1]])
        if k == "map":
            return F.struct(*[go(x).alias(n) for n, x in e[1].items()])
        if k == "not":
            return ~go(e[1]).cast("boolean")
        if k == "neg":
            return -go(e[1])
        if k == "isnull":
            x = go(e[1])
            return x.isNotNull() if e[2] else x.isNull()
        if k == "op":
            return self.operator(e, go(e[2]), go(e[3]), df, local)
        if k == "case":
            subject = go(e[1]) if e[1] else None
            out = None
            for c, v in e[2]:
                test = go(c).cast("boolean") if subject is None else (subject == go(c))
                out = F.when(test, go(v)) if out is None else out.when(test, go(v))
            return out.otherwise(go(e[3]))
        if k in ("comp", "quant"):
            var, source = (e[1], e[2]) if k == "comp" else (e[2], e[3])
            inside = lambda body: (lambda x: self.expr(body, env, df, {**local, var: x}))
            items = go(source)
            if k == "quant":
                test = inside(e[4])
                if e[1] == "single":
                    hits = F.size(F.filter(items, test))
                    unknown = F.size(F.filter(items, lambda x: test(x).isNull()))
                    return F.when(hits > 1, False).when(unknown > 0, F.lit(None)).otherwise(hits == 1)
                return {"any": F.exists, "all": F.forall, "none": lambda i, t: ~F.exists(i, t)}[e[1]](items, test)
            items = F.filter(items, inside(e[3])) if e[3] else items
            return F.transform(items, inside(e[4])) if e[4] else items
        if k == "index":
            x, i = go(e[1]), go(e[2])
            if self.kind(x, df, e[1], local) == "string":
                at = F.when(i < 0, F.length(x) + i).otherwise(i).cast("int")
                return F.when((at >= 0) & (at < F.length(x)), F.substring(x, at + 1, F.lit(1)))
            return F.try_element_at(x, F.when(i < 0, i).otherwise(i + 1).cast("int"))
        if k == "slice":
            x = go(e[1])
            text = self.kind(x, df, e[1], local) == "string"
            n = F.length(x) if text else F.size(x)
            low = F.greatest(go(e[2]) if e[2] else F.lit(0), F.lit(0)).cast("int")
            size = F.greatest((F.least(go(e[3]), n) if e[3] else n) - low, F.lit(0)).cast("int")
            return F.substring(x, low + 1, size) if text else F.slice(x, low + 1, size)
        if k == "call":
            return self.call(e, env, df, local)
        raise CypherError(f"cannot compile {k}")

    def operator(self, e: tuple, a: Column, b: Column, df: DataFrame, local: dict) -> Column:
        op = e[1]
        kinds = lambda: (self.kind(a, df, e[2], local), self.kind(b, df, e[3], local))
        if op in ("and", "or"):
            a, b = a.cast("boolean"), b.cast("boolean")
            return a & b if op == "and" else a | b
        if op == "xor":
            return a.cast("boolean") != b.cast("boolean")
        if op in ("=", "<>"):
            a, b = self.alike(a, b, e, df, local)
            plain = (a == b) if op == "=" else (a != b)
            if any(x[0] == "lit" and x[1] is not None for x in (e[2], e[3])):
                return plain
            # null equals null; null and a value are neither equal nor different
            return F.when(a.isNull() & b.isNull(), op == "=").otherwise(plain)
        if op in ("<", ">", "<=", ">="):
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if op == "=~":
            return F.call_function("rlike", a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        if op in ("starts", "ends", "contains"):
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[op](a, b)
        if op == "in":
            return F.array_contains(b, a) if e[3][0] != "list" else a.isin(*[self.expr(x, {}, df) for x in e[3][1]]) if all(x[0] == "lit" for x in e[3][1]) else F.array_contains(b, a)
        if op == "+":
            ka, kb = kinds()
            if ka.startswith("array") or kb.startswith("array"):
                return F.concat(a, b) if ka.startswith("array") and kb.startswith("array") else F.array_append(a, b) if ka.startswith("array") else F.array_prepend(b, a)
            return F.concat(a.cast("string"), b.cast("string")) if "string" in (ka, kb) else a + b
        if op == "/":
            return a.cast("double") / b.cast("double")
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        return a - b if op == "-" else a * b

    def call(self, e: tuple, env: dict, df: DataFrame, local: dict) -> Column:
        name, raw = e[1], e[2]
        v = env.get(raw[0][1]) if len(raw) == 1 and raw[0][0] == "var" and raw[0][1] not in local else None
        var = raw[0][1] if v else None
        if name == "count" and not e[3] and WEIGHT in df.columns:
            x = None if not raw else F.col(f"{var}__id") if v and v.kind == "node" else self.returned(var, env) if v and v.kind != "value" else self.expr(raw[0], env, df, local)
            return F.coalesce(F.sum(WEIGHT if x is None else F.when(x.isNotNull(), F.col(WEIGHT))), F.lit(0).cast("long"))
        if name in AGGREGATES:
            if v and v.kind != "value":
                return aggregate(name, [F.col(f"{var}__id") if v.kind == "node" else self.returned(var, env)], e[3])
            args = [self.expr(x, env, df, local) for x in raw]
            if name == "percentiledisc":
                # the built-in takes its order as a clause, so the values get a column of their own
                share = raw[1] if len(raw) > 1 else ("lit", 0.5)
                if share[0] not in ("lit", "param"):
                    raise CypherError("the share of a percentile must be a constant")
                h = f"__p{len(self.before)}"
                self.before[h] = args[0].cast("double")
                return F.expr(f"percentile_disc({float(share[1] if share[0] == 'lit' else self.params[share[1]])}) WITHIN GROUP (ORDER BY {h})")
            return aggregate(name, args, e[3])
        if v and v.kind in ("node", "edge", "path", "walk"):
            if name == "id":
                return F.col(f"{var}__id") if v.kind == "node" else F.lit(None).cast("long")
            if name in ("elementid", "qualifiedid"):
                return self.property(var, "qualifiedId", env)
            if name == "graphid":
                return F.col(f"{var if v.kind != 'path' else v.parts[0]}__graph_id")
            if name == "labels":
                covers = {x: [x, *sorted(k for k, ys in self.graph.aliases.items() if x in ys)] for x in self.graph.nodes}
                return F.element_at(F.create_map(*[c for x, ys in covers.items() for c in (F.lit(x), F.array(*map(F.lit, ys)))]), F.col(f"{var}__label"))
            if name == "type":
                return F.col(f"{var}__type") if v.kind == "edge" else F.lit(None).cast("string")
            if name in ("startnode", "endnode"):
                return F.col(f"{var}__{'src' if name == 'startnode' else 'dst'}")
            if name in ("properties", "keys"):
                own = [c for c in v.columns if c.rpartition("__")[2] not in ("label", "graph_id")]
                return F.to_json(F.struct(*[F.col(c).alias(c[len(var) + 2 :]) for c in own])) if name == "properties" else F.array(*[F.lit(c[len(var) + 2 :]) for c in own])
            if name == "length":
                return self.length(v, env) if v.kind == "path" else F.col(f"{var}__depth")
            if name == "nodes":
                return self.path_nodes(v, env)
            if name in ("relationships", "rels"):
                return self.path_edges(v, env)
            if name == "exists":
                return F.col(v.columns[0]).isNotNull()
        args = [self.expr(x, env, df, local) for x in raw]
        if name in ("size", "length"):
            return F.length(args[0]) if self.kind(args[0], df, raw[0], local) == "string" else F.when(args[0].isNotNull(), F.size(args[0]))
        if name == "reverse":
            return F.reverse(args[0])
        if name == "keys":
            kind = self.kind(args[0], df, raw[0], local)
            if kind.startswith("struct"):
                return F.array(*[F.lit(x) for x in df.select(args[0].alias("x")).schema["x"].dataType.names])
            return F.map_keys(args[0]) if kind.startswith("map") else F.lit(None).cast("array<string>")
        if name in MATH:
            args = [F.lit(None).cast("double") if self.kind(x, df, r, local) in ("boolean", "void") else x.try_cast("double") if self.kind(x, df, r, local) == "string" else x for x, r in zip(args, raw, strict=True)]
        if name not in SCALARS:
            raise CypherError(f"unknown function {e[4]}")
        return SCALARS[name](*args)


setattr(Compiler, "with", Compiler.with_)
setattr(Compiler, "return", Compiler.return_)


def _variables(e) -> set[str]:
    found: dict = {}
    used(e, found)
    return set(found)


def path_reads(p: Path) -> set[str]:
    parts = [*p.nodes, *p.edges]
    return {x.var for x in [p, *parts] if x.var} | _variables(tuple(e for x in parts for e in x.props.values()))


def reads(c: Clause) -> set[str]:
    """Variables that a clause names."""
    return _variables(tuple(e for e in [c.where, c.skip, c.limit, c.expr, *[o for o, _ in c.order], *[i.expr for i in c.items]] if e is not None)).union(*map(path_reads, c.paths))


def counts_only(c: Clause) -> bool:
    """Whether a projection groups, and its aggregates can be told from distinct rows and how often each occurs."""

    def plain(e) -> bool:
        if isinstance(e, dict):
            return all(map(plain, e.values()))
        if not isinstance(e, (tuple, list)):
            return True
        if e and e[0] == "call" and e[1] in AGGREGATES and e[1] not in ("count", "min", "max") and not (e[3] and e[1] == "collect"):
            return False
        return all(map(plain, e))

    return not c.star and any(has_aggregate(i.expr) for i in c.items) and all(plain(x) for x in [*[i.expr for i in c.items], *[o for o, _ in c.order]])


__all__ = ["GRAPHS", "Compiler", "render"]
