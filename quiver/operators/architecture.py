"""Architecture inference: from call sites and endpoints to a system's boundary, containers, components and their dependencies.

Counting over classes and calls is done by DataFrames; what is selected for a view (at most a few hundred rows) is arranged on the driver.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.operators.traverse import connected_components, cut, distances

#: The first parts of reverse domain names, runtimes, and the weights and limits of scores and views.
REVERSE_DNS = "app biz co com dev edu gov io me mil net org".split()
RUNTIMES = [("java.", "java"), ("javax.", "java"), ("jakarta.", "java"), ("jdk.", "java"), ("kotlin.", "kotlin"), ("scala.", "scala")]
SYNTHETIC, UNKNOWN = "sootup.dummy", "application"
PREFIX_DEPTH, DOMINANCE, SEPARATION, FAMILY_PARTS = 4, 0.85, 3, 3
UNIT_WEIGHTS = {"methods": 1, "endpoints": 10, "traffic": 1}
COMPONENT_WEIGHTS = {"endpoints": 300, "crossing": 200, "external": 100, "calls": 1, "methods": 1}
HELPER_PENALTY, SECOND_TOKEN = 4, 0.7
HELPER_PACKAGES = "common shared support util utils".split()
HELPER_CLASSES = "Helper Support Util Utils".split()
VIEW_EDGES, DEGREE, RELAX_BELOW, REDUCE_UP_TO = 12, 2, 6, 200
SHARED_DEPENDENCY, SHARED_CONTAINER = 2, 3
CONTEXT_ELEMENTS, CONTAINER_ELEMENTS, COMPONENT_ELEMENTS = 12, 12, 16


# predicates
def is_synthetic(c: Column) -> Column:
    return (c == SYNTHETIC) | c.startswith(f"{SYNTHETIC}.")


def runtime_of(c: Column) -> Column:
    """java, kotlin or scala for classes of a runtime, else null."""
    out = F.lit(None).cast("string")
    for prefix, name in RUNTIMES:
        out = F.when(c.startswith(prefix), name).otherwise(out)
    return out


def is_internal(c: Column, boundary: str) -> Column:
    return ~is_synthetic(c) & ((c == boundary) | c.startswith(f"{boundary}."))


def package_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


def root_parts(parts: Column) -> Column:
    """How many parts name a namespace's owner: two of a reverse domain name, else one."""
    return F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(REVERSE_DNS), 2).otherwise(F.least(F.size(parts), F.lit(1)))


def package_unit(c: Column, boundary: str) -> Column:
    """The boundary and one part more, for an internal class; the owner's namespace of another."""
    package = package_of(c)
    parts = F.split(package, r"\.")
    below = F.split(F.substring(package, len(boundary) + 2, 1 << 20), r"\.")[0]
    inside = F.when(F.length(package) > len(boundary) + 1, F.concat(F.lit(f"{boundary}."), below)).otherwise(F.lit(boundary))
    return F.when(package == "", F.lit(UNKNOWN)).when(is_internal(c, boundary), inside).otherwise(F.array_join(F.slice(parts, F.lit(1), root_parts(parts)), "."))


# the system
def system_boundary(classes: DataFrame, depth: int = PREFIX_DEPTH) -> str:
    """The namespace that owns most of classes (class), and its child as long as that holds most of it and leads its peers clearly.

    One aggregation for each part of the name, of which the driver gets two rows: no prefix is left out.
    """
    packages = classes.where(~is_synthetic(F.col("class"))).select(package_of(F.col("class")).alias("package")).where("package <> ''").groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("package", r"\.")
    packages = cut(packages.select(parts.alias("parts"), root_parts(parts).alias("root"), "n"))
    top = packages.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("root")), ".").alias("p")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(1).collect()
    if not top:
        return UNKNOWN
    at, total = top[0]["p"], top[0]["n"]
    while at.split(".")[0] in REVERSE_DNS and (k := at.count(".") + 2) <= depth:
        inside = packages.where((F.size("parts") >= k) & (F.array_join(F.slice("parts", 1, k - 1), ".") == at))
        best = inside.groupBy(F.array_join(F.slice("parts", 1, k), ".").alias("p")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(2).collect()
        if not best or best[0]["n"] < DOMINANCE * total or len(best) > 1 and best[0]["n"] < SEPARATION * best[1]["n"]:
            break
        at, total = best[0]["p"], best[0]["n"]
    return at


def main_reachability(methods: DataFrame, call_sites: DataFrame, boundary: str, start_class: str | None = None) -> DataFrame:
    """One row: main_methods, reachable_methods, reachable_classes (internal ones) and external_targets.

    methods: method, class, name.  call_sites: caller, callee, callee_class.  Calls are followed inside the boundary.
    """
    mains = methods.where("name = 'main'")
    if start_class is not None:
        own = mains.where(F.col("class") == start_class)
        mains = mains if own.isEmpty() else own
    inside = cut(methods.where(is_internal(F.col("class"), boundary)).select("method", "class").distinct())
    calls = call_sites.join(inside.select(F.col("method").alias("caller")), "caller", "left_semi")
    steps = calls.join(inside.select(F.col("method").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    seen = cut(distances(steps, mains.select(F.col("method").alias("id")), None).select(F.col("u").alias("method")).distinct())
    reached = inside.join(seen, "method", "left_semi")
    out = calls.join(seen.withColumnRenamed("method", "caller"), "caller", "left_semi").join(inside.select(F.col("method").alias("callee")), "callee", "left_anti").where(~is_synthetic(F.col("callee_class")))
    one = reached.agg(F.count(F.lit(1)).alias("reachable_methods"), F.count_distinct("class").alias("reachable_classes"))
    return mains.agg(F.count(F.lit(1)).alias("main_methods")).crossJoin(one).crossJoin(out.agg(F.count_distinct("callee_class").alias("external_targets")))


def subject_role(reach: dict, endpoints: int, main_class: bool = False, start_class: str | None = None, boot_layout: bool = False, boot_launcher: bool = False, boot_origin: bool = False) -> str:
    """application or library, by manifest, archive layout and what main methods reach (a row of main_reachability)."""
    mains, methods, classes, external = (reach[k] for k in ("main_methods", "reachable_methods", "reachable_classes", "external_targets"))
    booted = boot_layout and boot_launcher and boot_origin and mains > 0 and methods > 1 and classes > 1
    started = main_class and bool(start_class) and mains > 0
    serves = mains > 0 and endpoints > 0 and methods > 1
    runs = mains > 0 and methods >= external and classes > 1
    return "application" if booted or started or serves or runs else "library"


# dependencies
def namespace_group(c: Column) -> Column:
    """The packages in front of the first capitalised part: three of a reverse domain name, else one."""
    parts = F.filter(F.split(c, r"\."), lambda x: x != "")
    low = F.array_position(F.transform(parts, lambda x: x.rlike(r"^\p{Lu}")), True)
    packages = F.when(low > 1, F.slice(parts, F.lit(1), (low - 1).cast("int"))).otherwise(parts)
    n = F.when(root_parts(packages) == 2, F.least(F.size(packages), F.lit(FAMILY_PARTS))).otherwise(root_parts(packages))
    return F.when(F.size(packages) > 0, F.array_join(F.slice(packages, F.lit(1), n), ".")).otherwise(c)


def external_dependencies(weights: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(key, name, weight, source, kind, confidence) of what classes outside belong to.

    weights: class, weight.  origins: class, artifact.  A class belongs to its artifact, else to its runtime, else to its namespace;
    namespaces that share their first three parts are one.
    """
    w = weights if origins is None else weights.join(origins, "class", "left")
    artifact = F.lit(None).cast("string") if origins is None else F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim("artifact"), "/+$", ""), "[^/]*$", 0), r"\.jar$", "")
    key = F.when(artifact != "", F.concat(F.lit("artifact:"), artifact)).when(runtime_of(F.col("class")).isNotNull(), F.concat(F.lit("runtime:"), runtime_of(F.col("class")))).otherwise(F.concat(F.lit("namespace:"), namespace_group(F.col("class"))))
    per = w.select(key.alias("key"), "weight").groupBy("key").agg(F.sum("weight").alias("weight"))
    family = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("key", "^namespace:", ""), r"\."), lambda x: x != ""), 1, FAMILY_PARTS), ".")
    n = F.count(F.lit(1)).over(Window.partitionBy("family"))
    per = per.withColumn("family", F.when(F.col("key").startswith("namespace:"), F.concat(F.lit("namespace:"), family)).otherwise(F.col("key"))).withColumn("n", n)
    out = per.groupBy(F.when(F.col("n") > 1, F.col("family")).otherwise(F.col("key")).alias("key")).agg(F.sum("weight").alias("weight"))
    source = F.split_part("key", F.lit(":"), F.lit(1))
    name = F.expr("substring(key, instr(key, ':') + 1)")
    return out.select("key", F.when(source == "runtime", F.concat(F.initcap(name), F.lit(" Runtime"))).otherwise(name).alias("name"), "weight", source.alias("source"), F.when(source == "runtime", "runtime").when(source == "artifact", "library").otherwise("external-system").alias("kind"), F.when(source == "namespace", "medium").otherwise("high").alias("confidence"))


def library_families(dependencies: DataFrame) -> DataFrame:
    """(id, name, weight, members): libraries whose artifacts, without versions, share the part before the first hyphen are one."""
    base = F.regexp_replace("name", r"-\d+(?:[.-][0-9A-Za-z]+)*$", "")
    d = dependencies.withColumn("base", F.when(F.col("source") == "artifact", base)).withColumn("prefix", F.when(F.col("base").contains("-"), F.split_part("base", F.lit("-"), F.lit(1))))
    first = F.when(F.col("base").isNotNull(), F.split_part("base", F.lit("-"), F.lit(1)))
    shared = d.where("prefix <> ''").groupBy(F.col("prefix").alias("first")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first", F.lit(True).alias("is_shared"))
    placed = d.withColumn("first", first).join(shared, "first", "left")
    family = F.coalesce("is_shared", F.lit(False))
    return placed.groupBy(F.when(family, F.concat(F.lit("library:"), F.col("first"))).otherwise(F.col("key")).alias("id"), F.when(family, F.col("first")).otherwise(F.col("name")).alias("name")).agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("name")).alias("members"))


# containers
def traffic(calls: DataFrame) -> DataFrame:
    """(a, b, weight): undirected calls between units. calls: source, target."""
    return calls.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, component) of units with traffic. pairs: a, b, weight.

    Units are joined where each is the other's strongest neighbour (ties to the smaller name), and a unit joins its strongest neighbour
    if at least half of its traffic is with it; the second of a mutual pair (by name) is not asked again.
    """
    both = cut(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")))
    best = both.groupBy("a").agg(F.min(F.struct((-F.col("weight")).alias("minus"), "b")).alias("x"), F.sum("weight").alias("total")).select("a", F.col("x.b").alias("b"), (-F.col("x.minus")).alias("weight"), "total")
    other = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
    joined = best.join(other, "b").withColumn("mutual", F.col("back") == F.col("a"))
    steps = joined.where(F.col("mutual") | (2 * F.col("weight") >= F.col("total"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    alone = best.select(F.col("a").alias("src"), F.col("a").alias("dst"))
    return connected_components(steps.union(alone))


def package_units(methods: DataFrame, call_sites: DataFrame, endpoints: DataFrame, boundary: str) -> tuple[DataFrame, DataFrame]:
    """(unit, methods, endpoints, traffic) of internal units, and (a, b, weight) between them.

    methods: class.  call_sites: caller_class, callee_class.  endpoints: class.
    """
    unit = lambda c: package_unit(F.col(c), boundary)
    own = lambda df, name: df.where(is_internal(F.col("class"), boundary)).groupBy(unit("class").alias("unit")).agg(F.count(F.lit(1)).alias(name))
    inner = call_sites.where(is_internal(F.col("caller_class"), boundary) & is_internal(F.col("callee_class"), boundary)).select(unit("caller_class").alias("source"), unit("callee_class").alias("target"))
    pairs = cut(traffic(inner))
    busy = pairs.select("a", "weight").union(pairs.select("b", "weight")).groupBy(F.col("a").alias("unit")).agg(F.sum("weight").alias("traffic"))
    every = inner.select(F.explode(F.array("source", "target")).alias("unit")).distinct()
    units = every.join(own(methods, "methods"), "unit", "full").join(own(endpoints, "endpoints"), "unit", "full").join(busy, "unit", "left")
    return cut(units.select("unit", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("methods", "endpoints", "traffic")])), pairs


def container_layout(units: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """(unit, container, score): the units of the best clusters; a container is named by its smallest unit."""
    placed = units.join(clusters(pairs).withColumnRenamed("id", "unit"), "unit", "left").withColumn("container", F.coalesce("component", "unit")).drop("component")
    score = sum((F.sum(c) * w for c, w in UNIT_WEIGHTS.items()), F.lit(0))
    best = placed.groupBy("container").agg(score.cast("long").alias("score"), F.sum("traffic").alias("t")).orderBy(F.desc("score"), F.desc("t"), "container").limit(limit)
    return placed.join(best.select("container", "score"), "container").select("unit", "container", "score", "methods", "endpoints", "traffic")


def humanized(c: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[-_ ]+", " ")))


def container_names(layout: DataFrame, all_units: DataFrame, boundary: str) -> DataFrame:
    """(container, name): the token with the best sum of unit scores over its document frequency, and a second one that comes near it."""
    tokens = lambda c: F.filter(F.split(F.regexp_replace(c, f"^{re.escape(boundary)}", ""), r"\."), lambda x: x != "")
    df = all_units.select(F.explode(F.array_distinct(tokens(F.col("unit")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("methods") * 2 + F.col("endpoints") * UNIT_WEIGHTS["endpoints"] + F.col("traffic") * UNIT_WEIGHTS["traffic"]
    scored = layout.select("container", weight.alias("w"), F.explode(tokens(F.col("unit"))).alias("token")).join(df, "token").groupBy("container", "token").agg(F.sum(F.col("w") / F.col("df")).alias("score"))
    ranked = scored.withColumn("n", F.row_number().over(Window.partitionBy("container").orderBy(F.desc("score"), "token"))).where("n <= 2")
    two = ranked.groupBy("container").agg(F.max(F.when(F.col("n") == 1, F.col("token"))).alias("t1"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("n") == 2, F.col("token"))).alias("t2"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("s2"))
    first, second = humanized(F.col("t1")), humanized(F.col("t2"))
    name = F.when((F.col("s1") > 0) & (F.col("s2") >= F.col("s1") * SECOND_TOKEN) & (first != second), F.concat(first, F.lit(" and "), second)).otherwise(first)
    return layout.select("container").distinct().join(two, "container", "left").select("container", F.coalesce(name, F.lit(boundary)).alias("name"))


def container_dependencies(call_sites: DataFrame, layout: DataFrame, boundary: str) -> DataFrame:
    """(source, target, weight): directed calls between containers."""
    of = layout.select("unit", "container")
    calls = call_sites.where(is_internal(F.col("caller_class"), boundary) & is_internal(F.col("callee_class"), boundary)).select(package_unit(F.col("caller_class"), boundary).alias("u1"), package_unit(F.col("callee_class"), boundary).alias("u2"))
    met = calls.join(of.select(F.col("unit").alias("u1"), F.col("container").alias("source")), "u1").join(of.select(F.col("unit").alias("u2"), F.col("container").alias("target")), "u2")
    return met.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


# kinds and scores
def component_kind(endpoints_: Column, external: Column, incoming: Column, outgoing: Column) -> Column:
    return F.when(endpoints_ > 0, "entrypoint").when(external > F.greatest(incoming, outgoing), "integration").when(outgoing > incoming, "orchestrator").when(incoming > outgoing, "shared").when(incoming + outgoing > 0, "coordination").otherwise("domain")


def container_kind(endpoints_: Column, external: Column, incoming: Column, outgoing: Column) -> Column:
    """As for components, but calls outside that equal the most count as integration, and a balance is a capability."""
    most = F.greatest(incoming, outgoing, external)
    return F.when(endpoints_ > 0, "interface").when((external > 0) & (external == most), "integration").when(outgoing > incoming, "orchestrator").when(incoming > outgoing, "shared").otherwise("capability")


def component_score(endpoints_: Column, crossing: Column, external: Column, calls: Column, methods: Column) -> Column:
    parts = {"endpoints": endpoints_, "crossing": crossing, "external": external, "calls": calls, "methods": methods}
    return sum((c * COMPONENT_WEIGHTS[k] for k, c in parts.items()), F.lit(0)).cast("long")


def class_score(cls: Column, boundary: str, endpoints_: Column, crossing: Column, calls: Column, methods: Column, peers: Column) -> Column:
    """The score of a class as a component's representative; helpers by name, without evidence of their own, get a quarter."""
    base = crossing * COMPONENT_WEIGHTS["crossing"] + endpoints_ * COMPONENT_WEIGHTS["external"] + calls + methods
    package = F.split(package_of(F.regexp_replace(cls, f"^{re.escape(boundary)}\\.", "")), r"\.")
    named = F.arrays_overlap(package, F.array(*map(F.lit, HELPER_PACKAGES))) | cls.rlike(f"({'|'.join(HELPER_CLASSES)})$")
    helper = named & (endpoints_ == 0) & (crossing == 0) & (peers > 1)
    return F.when(helper, F.floor(base / HELPER_PENALTY)).otherwise(base).cast("long")


def dependency_kind(source: Column, target: Column) -> Column:
    return F.when(source.isin("interface", "entrypoint"), "routes-to").when(source == "orchestrator", "orchestrates").when(target.isin("shared", "integration"), "uses").otherwise("collaborates-with")


def layer_rank(kind: Column) -> Column:
    return F.when(kind.isin("interface", "entrypoint"), 0).when(kind.isin("orchestrator", "integration"), 1).when(kind == "shared", 3).otherwise(2)


def oriented(dependencies: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source, target, kind, weight): dependencies turned so that they go from the upper layer to the lower. kinds: id, kind."""
    side = lambda c: kinds.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
    d = dependencies.join(side("source"), "source").join(side("target"), "target")
    turn = layer_rank(F.col("source_kind")) > layer_rank(F.col("target_kind"))
    ends = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    d = d.select(ends("source", "target").alias("source"), ends("target", "source").alias("target"), dependency_kind(ends("source_kind", "target_kind"), ends("target_kind", "source_kind")).alias("kind"), "weight")
    return d.groupBy("source", "target", "kind").agg(F.sum("weight").alias("weight"))


def shared_fan_in(edges: DataFrame, keep: int) -> DataFrame:
    """edges (source, target, weight, ..) with the keep strongest into each target (ties by source)."""
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("weight"), "source"))).where(F.col("__n") <= keep).drop("__n")


# views, on the driver
@dataclass
class View:
    level: str
    elements: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)


def reduced(edges: list[dict], keep_runtime: bool = False) -> list[dict]:
    """edges without those that another path of at least their weight stands for (any path, for layers); all, beyond REDUCE_UP_TO.

    The widest path is found by settling nodes in the order of the least weight on the way to them.
    """
    open_ = [e for e in edges if not (keep_runtime and e["kind"] == "runs-on")]
    if len(open_) > REDUCE_UP_TO:
        return edges
    weight = lambda e: max(1, e.get("weight") or 1)

    def widest(omit: dict) -> float:
        best, todo, done = {omit["source"]: float("inf")}, {omit["source"]}, set()
        while todo:
            at = max(todo, key=lambda x: (best[x], x))
            todo.remove(at)
            done.add(at)
            for e in open_:
                if e is not omit and e["source"] == at and e["target"] not in done and min(best[at], weight(e)) > best.get(e["target"], 0):
                    best[e["target"]] = min(best[at], weight(e))
                    todo.add(e["target"])
        return best.get(omit["target"], 0) if omit["target"] != omit["source"] else 0

    gone = [e for e in open_ if widest(e) >= (1 if e["kind"] in ("runs-on", "builds-on") else weight(e))]
    return [e for e in edges if not any(e is g for g in gone)]


def readable(edges: list[dict], most: int = VIEW_EDGES, degree: int = DEGREE, relax_below: int = RELAX_BELOW) -> list[dict]:
    """The strongest edges, at most degree into and out of each element; without that bound where too few are left."""
    if len(edges) <= 1:
        return edges
    told = [e for e in edges if e["kind"] != "collaborates-with"] or edges
    unique = {(e["source"], e["target"], e["kind"]): e for e in reversed(told)}
    order = reduced(sorted(unique.values(), key=lambda e: (-(e.get("weight") or 0), e["source"], e["target"], e["kind"])))
    out, leaving, entering = [], {}, {}
    for bounded in (True, False):
        if not bounded and len(out) >= min(most, len(order), relax_below):
            break
        for e in order:
            a, b = e["source"], e["target"]
            full = bounded and (leaving.get(a, 0) >= degree or entering.get(b, 0) >= degree)
            if len(out) < most and not full and not any(e is x for x in out):
                out.append(e)
                leaving[a], entering[b] = leaving.get(a, 0) + 1, entering.get(b, 0) + 1
    return out


def infer_views(methods: DataFrame, call_sites: DataFrame, endpoints: DataFrame, origins: DataFrame | None = None, level: str = "all") -> dict[str, View]:
    """The context, container and component views, or one of them.

    methods: method, class, name.  call_sites: caller, callee, caller_class, callee_class.  endpoints: class.
    """
    boundary = system_boundary(methods.select("class"))
    reach = main_reachability(methods, call_sites, boundary).first().asDict()
    n = endpoints.where(is_internal(F.col("class"), boundary)).count()
    role = subject_role(reach, n)
    subject = {"id": f"system:{boundary}", "name": boundary.rpartition(".")[2].capitalize(), "kind": role}
    outside = call_sites.where(is_internal(F.col("caller_class"), boundary) & ~is_internal(F.col("callee_class"), boundary) & ~is_synthetic(F.col("callee_class")))
    external = cut(external_dependencies(outside.groupBy(F.col("callee_class").alias("class")).agg(F.count(F.lit(1)).alias("weight")), origins))
    out: dict[str, View] = {}
    if level in ("context", "all"):
        actor = {"id": "actor", "name": ("HTTP Clients" if n else "Operators") if role == "application" else "Host Applications", "kind": "person"}
        around = library_families(external).orderBy(F.desc("weight"), "id").limit(CONTEXT_ELEMENTS - 2).collect()
        links = [{"source": "actor", "target": subject["id"], "kind": "uses", "weight": max(1, n)}] + [{"source": subject["id"], "target": r["id"], "kind": "runs-on" if r["id"].startswith("runtime:") else "uses", "weight": r["weight"]} for r in around]
        out["context"] = View("context", [actor, subject, *({"id": r["id"], "name": r["name"], "kind": "dependency"} for r in around)], links)
    units, pairs = package_units(methods, call_sites, endpoints, boundary)
    for name, limit in (("container", CONTAINER_ELEMENTS), ("component", COMPONENT_ELEMENTS)):
        if level not in (name, "all"):
            continue
        layout = cut(container_layout(units, pairs, limit))
        names = {r["container"]: r["name"] for r in container_names(layout, units, boundary).collect()}
        calls = cut(container_dependencies(call_sites, layout, boundary))
        of = layout.select("unit", "container")
        beyond = outside.where(runtime_of(F.col("callee_class")).isNull()).select(package_unit(F.col("caller_class"), boundary).alias("unit")).join(of, "unit").groupBy("container").agg(F.count(F.lit(1)).alias("external"))
        went = calls.groupBy(F.col("source").alias("container")).agg(F.sum("weight").alias("outgoing"))
        came = calls.groupBy(F.col("target").alias("container")).agg(F.sum("weight").alias("incoming"))
        per = layout.groupBy("container").agg(F.sum("endpoints").alias("endpoints"), F.sum("methods").alias("methods"), F.sum("traffic").alias("traffic"))
        for df in (beyond, went, came):
            per = per.join(df, "container", "left")
        c = {x: F.coalesce(x, F.lit(0)) for x in ("endpoints", "external", "incoming", "outgoing", "methods", "traffic")}
        kind = (container_kind if name == "container" else component_kind)(c["endpoints"], c["external"], c["incoming"], c["outgoing"])
        kinds = cut(per.select(F.col("container").alias("id"), kind.alias("kind"), component_score(c["endpoints"], c["incoming"] + c["outgoing"], c["external"], c["traffic"], c["methods"]).alias("score")))
        links = oriented(calls, kinds)
        links = shared_fan_in(links, SHARED_CONTAINER) if name == "container" else links
        # at most limit containers are left, so a view's rows are few
        edges = [r.asDict() for r in links.orderBy(F.desc("weight"), "source", "target").collect()]
        elements = [{"id": r["id"], "name": names[r["id"]], "kind": r["kind"], "score": r["score"]} for r in kinds.orderBy(F.desc("score"), "id").collect()]
        out[name] = View(name, elements, readable(edges) if name == "component" else reduced(edges))
    return out


# renderers
def _slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_") or "x"


def to_json(view: View) -> str:
    return json.dumps({"level": view.level, "elements": view.elements, "relationships": view.relationships}, sort_keys=True)


def to_dsl(view: View) -> str:
    """A workspace in the text language of architecture models."""
    tag = {"context": "softwareSystem", "container": "container", "component": "component"}[view.level]
    lines = ["workspace {", "  model {"]
    lines += [f'    {_slug(e["id"])} = {"person" if e["kind"] == "person" else tag} "{e["name"]}" "{e["kind"]}"' for e in view.elements]
    lines += [f'    {_slug(r["source"])} -> {_slug(r["target"])} "{r["kind"]}"' for r in view.relationships]
    return "\n".join([*lines, "  }", "}"])


def to_mermaid(view: View) -> str:
    lines = ["flowchart LR"] + [f'  {_slug(e["id"])}["{e["name"]}"]' for e in view.elements]
    return "\n".join(lines + [f"  {_slug(r['source'])} -->|{r['kind']}| {_slug(r['target'])}" for r in view.relationships])


def to_plantuml(view: View) -> str:
    lines = ["@startuml"] + [f'{"actor" if e["kind"] == "person" else "rectangle"} "{e["name"]}" as {_slug(e["id"])}' for e in view.elements]
    return "\n".join([*lines, *[f"{_slug(r['source'])} --> {_slug(r['target'])} : {r['kind']}" for r in view.relationships], "@enduml"])
