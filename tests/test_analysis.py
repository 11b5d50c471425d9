import random

from pyspark.sql import functions as F

from quiver.operators import analysis as A
from quiver.operators.traverse import closure, connected_components, expand, shortest_paths, subgraph


def test_slice_stops_at_the_depth_limit(spark):
    chain = spark.range(64).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start, source = spark.createDataFrame([(64,)], "id long"), spark.createDataFrame([(0,), (20,)], "id long")
    assert [(r["source"], r["depth"]) for r in A.backward_slice(chain, start, source).collect()] == [(20, 44)]


def test_expand_on_a_cycle_with_parallel_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "src long, dst long")
    got = sorted((r["v"], r["depth"]) for r in expand(edges, spark.createDataFrame([(1,)], "id long"), 1, 3).collect())
    assert got == [(1, 2), (2, 1), (2, 1)]


def test_dead_branch_and_methods(spark):
    scopes = spark.createDataFrame([(5, "m", "EQ", 0, [7], [8])], "condition_id long, method string, op string, comparand int, true_ids array<long>, false_ids array<long>")
    flow = spark.createDataFrame([(1, 5)], "src long, dst long")
    dead = A.dead_branches(spark.createDataFrame([(1, True)], "id long, value boolean"), flow, scopes).collect()
    assert [(r["kind"], r["dead_ids"]) for r in dead] == [("BRANCH_TRUE", [7])]
    calls = spark.createDataFrame([(7, "m", "a"), (9, "a", "b"), (8, "m", "c"), (10, "b", "X.<init>")], "id long, caller string, callee string")
    assert {r["method"] for r in A.dead_methods(calls, spark.createDataFrame([(7,)], "id long")).collect()} == {"a", "b"}


def settled(calls, off):
    """Dead methods by rounds over all calls."""
    off, dead = set(off), set()
    while True:
        named = {m for _, _, m in calls if "<init>" not in m}
        now = {m for m in named if all(i in off or c in dead for i, c, x in calls if x == m)}
        if now == dead:
            return dead
        dead = now


def test_dead_methods_of_any_shape(spark):
    rng = random.Random(5)
    seen = 0
    for n, density, share in ((40, 1.0, 0.3), (60, 1.6, 0.6), (50, 2.5, 0.7), (30, 1.2, 0.0)):
        name = lambda k: f"m{k}" if k % 11 else f"C{k}.<init>"
        calls = [(i, name(rng.randrange(n)), name(rng.randrange(n))) for i in range(int(n * density))]
        # a chain, a ring that is fed by it, and a ladder of methods with two callers each
        calls += [(1000 + k, f"c{k}", f"c{k + 1}") for k in range(37)] + [(2000 + k, f"r{k}", f"r{(k + 1) % 6}") for k in range(6)] + [(2100, "c37", "r0")]
        calls += [(3000 + 4 * k + j, f"l{k}{a}", f"l{k + 1}{b}") for k in range(5) for j, (a, b) in enumerate(("xx", "xy", "yx", "yy"))] + [(3100, "c20", "l0x"), (3101, "c9", "l0y"), (3102, "m1", "l3x")]
        off = [i for i, _, _ in calls if i < 1000 and rng.random() < share] + [1000, 3102, 2003][: 2 + n % 3]
        got = [r["method"] for r in A.dead_methods(spark.createDataFrame(calls, "id long, caller string, callee string"), spark.createDataFrame([(i,) for i in off], "id long")).collect()]
        want = settled(calls, off)
        assert sorted(got) == sorted(want)
        seen += len(want)
    assert seen > 100
    assert A.dead_methods(spark.createDataFrame([(1, None, "a"), (2, "a", "b")], "id long, caller string, callee string"), spark.createDataFrame([(2,)], "id long")).collect() == [("b",)]


def test_dead_methods_of_a_long_chain_take_few_jobs(spark):
    calls = spark.range(250).select("id", F.concat(F.lit("m"), "id").alias("caller"), F.concat(F.lit("m"), F.col("id") + 1).alias("callee"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert A.dead_methods(calls, spark.createDataFrame([(0,)], "id long")).count() == 250
    # in rounds over all calls, each a job at least, there would be 250
    assert jobs() - before < 125


def test_endpoints(spark):
    rows = [("RequestMapping", "C", None, ["/api/"], None), ("GetMapping", "C", "list", ["/items", "all/"], None), ("RequestMapping", "D", "x", [], "PUT")]
    got = {(r["path"], r["verb"]) for r in A.endpoints(spark.createDataFrame(rows, "name string, class string, member string, paths array<string>, verb string")).collect()}
    assert got == {("/api/items", "GET"), ("/api/all", "GET"), ("/", "PUT")}


def test_argument_constants_and_patterns(spark):
    sites = spark.createDataFrame([(4, "a.B", "f", [3]), (5, "a.C", "g", [9])], "id long, callee_class string, callee_name string, arguments array<long>")
    flow = spark.createDataFrame([(1, 3)], "src long, dst long")
    found = A.argument_constants(sites.where(A.method_pattern(cls="a.*", name="f")), flow, spark.createDataFrame([(1,)], "id long")).collect()
    assert [(r["call_site"], r["constant"]) for r in found] == [(4, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (1, 2)], "src long, dst long")
    assert {(r["id"], r["component"]) for r in connected_components(edges).collect()} == {(7, 7), (8, 7), (9, 7), (1, 1), (2, 1)}


def test_subgraph_is_whole(spark):
    star = spark.range(1, 6001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    hub = spark.createDataFrame([(0,)], "id long")
    nodes, edges = subgraph(star, hub, depth=1)
    assert (nodes.count(), edges.count()) == (6001, 6000)
    chain = spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert subgraph(chain, hub, depth=7)[1].count() == 7
    nodes, edges = subgraph(star, hub, depth=1, max_nodes=3, max_edges=1)
    assert ([r["id"] for r in nodes.orderBy("dist", "id").collect()], [r["src"] for r in edges.collect()]) == ([0, 1, 2], [1])


def test_walks_from_nothing_and_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(130)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert closure(edges, ids(0)).count() == 130  # further than any limit on levels
    assert closure(edges, ids(500)).count() == closure(edges.limit(0), ids(1)).count() == closure(edges, spark.createDataFrame([], "id long")).count() == 0
    tree, _ = shortest_paths(edges, ids(120), None)
    assert {r["u"]: len(r["path"]) for r in tree.collect()} == {k: k - 120 for k in range(120, 131)}


def test_propagation_path_stays_on_its_source(spark):
    flow = spark.createDataFrame([(1, 5, "ASSIGN"), (5, 9, "PARAMETER_PASS"), (2, 9, "FIELD_LOAD"), (3, 2, "FIELD_STORE"), (4, 2, "CAST")], "src long, dst long, kind string")
    sources = spark.createDataFrame([(1, "constant"), (2, "field"), (3, "constant")], "id long, source_type string")
    paths = A.propagation_paths(flow, spark.createDataFrame([(9,)], "id long"), sources)
    got = {r["source"]: (r["depth"], [(s["id"], s["kind"]) for s in r["steps"]]) for r in paths.collect()}
    assert got == {1: (2, [(1, "ASSIGN"), (5, "PARAMETER_PASS"), (9, None)]), 2: (1, [(2, "FIELD_LOAD"), (9, None)]), 3: (2, [(3, "FIELD_STORE"), (2, "FIELD_LOAD"), (9, None)])}
    only = A.field_steps(flow, spark.createDataFrame([(2,)], "id long"))
    assert {(r["src"], r["dst"]) for r in only.collect()} == {(1, 5), (5, 9), (2, 9), (3, 2)}
