from pyspark.sql import functions as F

from quiver.operators import architecture as K


def test_clusters(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string, weight long")
    got = lambda rows: {r["id"]: r["component"] for r in K.clusters(make(rows)).collect()}
    assert got([("a", "b", 5), ("b", "c", 2), ("c", "d", 3)]) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    # c has half of its traffic with b, e has less than half with any
    assert got([("a", "b", 9), ("b", "c", 2), ("c", "e", 2), ("d", "e", 1), ("e", "f", 1)])["c"] == "a"


def test_system_boundary(spark):
    make = lambda *rows: spark.createDataFrame([(c,) for c, n in rows for _ in range(n)], "class string")
    assert K.system_boundary(make(("com.acme.shop.cart.A", 20), ("org.x.Y", 1))) == "com.acme.shop.cart"
    assert K.system_boundary(make(("com.acme.shop.A", 10), ("com.acme.stock.B", 9))) == "com.acme"
    assert K.system_boundary(make(("tool.inner.A", 20))) == "tool"
    assert K.system_boundary(make(("NoPackage", 3))) == K.UNKNOWN


def program(spark):
    calls, methods = [], []
    units = {"web": ["Api"], "core": ["Service", "Rules"], "store": ["Repository"]}
    for u, classes in units.items():
        methods += [(f"com.acme.{u}.{c}.m{k}", f"com.acme.{u}.{c}", f"m{k}") for c in classes for k in range(3)]
    methods += [("com.acme.web.Api.main", "com.acme.web.Api", "main")]
    link = lambda a, b, n: calls.extend([(f"com.acme.{a}", f"com.acme.{b}" if not b.startswith("org") else b)] * n)
    link("web.Api", "core.Service", 6), link("core.Service", "store.Repository", 4), link("core.Rules", "core.Service", 2), link("store.Repository", "org.db.driver.Pool", 5), link("web.Api", "org.db.tools.X", 1)
    rows = [(f"{a}.m0" if k else "com.acme.web.Api.main", f"{b}.m0", a, b) for k, (a, b) in enumerate(calls)]
    return spark.createDataFrame(methods, "method string, class string, name string"), spark.createDataFrame(rows, "caller string, callee string, caller_class string, callee_class string"), spark.createDataFrame([("com.acme.web.Api",)], "class string")


def test_reach_and_role(spark):
    methods, calls, _ = program(spark)
    got = K.main_reachability(methods, calls, "com.acme").first().asDict()
    assert got == {"main_methods": 1, "reachable_methods": 3, "reachable_classes": 3, "external_targets": 1}
    assert K.subject_role(got, 1) == "application" and K.subject_role(got | {"main_methods": 0}, 1) == "library"


def test_external_dependencies(spark):
    w = spark.createDataFrame([("org.db.driver.Pool", 5), ("org.db.tools.X", 1), ("java.util.List", 9), ("okhttp3.internal.A", 2), ("lib.A", 3), ("lib.B", 4)], "class string, weight long")
    origins = spark.createDataFrame([("lib.A", "libs/web-core-1.2.jar"), ("lib.B", "libs/web-json-2.0.1.jar")], "class string, artifact string")
    got = {r["key"]: (r["name"], r["weight"], r["kind"], r["confidence"]) for r in K.external_dependencies(w, origins).collect()}
    assert got["runtime:java"] == ("Java Runtime", 9, "runtime", "high") and got["namespace:okhttp3"] == ("okhttp3", 2, "external-system", "medium")
    assert got["namespace:org.db.driver"][1] == 5 and got["artifact:web-core-1.2"][2] == "library"
    families = {r["id"]: (r["weight"], r["members"]) for r in K.library_families(K.external_dependencies(w, origins)).collect()}
    assert families["library:web"] == (7, ["web-core-1.2", "web-json-2.0.1"])


def test_views(spark):
    methods, calls, endpoints = program(spark)
    views = K.infer_views(methods, calls, endpoints)
    assert set(views) == {"context", "container", "component"}
    kinds = {e["id"]: e["kind"] for e in views["container"].elements}
    assert kinds == {"com.acme.core": "interface"}  # each unit's strongest neighbour joins the three
    assert views["context"].elements[1]["kind"] == "application"
    for text, mark in ((K.to_json(views["context"]), '"level": "context"'), (K.to_dsl(views["context"]), "workspace {"), (K.to_mermaid(views["context"]), "flowchart"), (K.to_plantuml(views["context"]), "@startuml")):
        assert mark in text and "HTTP" in text


def test_kinds_and_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = lambda *xs: [F.lit(x) for x in xs]
    assert [one(K.component_kind(*lit(*x))) for x in ((1, 0, 0, 0), (0, 3, 2, 2), (0, 0, 1, 2), (0, 0, 2, 1), (0, 0, 1, 1), (0, 0, 0, 0))] == ["entrypoint", "integration", "orchestrator", "shared", "coordination", "domain"]
    assert [one(K.container_kind(*lit(*x))) for x in ((0, 2, 2, 1), (0, 0, 1, 1))] == ["integration", "capability"]
    assert one(K.component_score(*lit(1, 1, 1, 2, 3))) == 605
    score = lambda name, peers: one(K.class_score(F.lit(name), "com.acme", *lit(0, 0, 8, 4), F.lit(peers)))
    assert (score("com.acme.util.Strings", 3), score("com.acme.a.TextHelper", 3), score("com.acme.a.Text", 3), score("com.acme.a.TextHelper", 1)) == (3, 3, 12, 12)
    assert [one(K.dependency_kind(*lit(*x))) for x in (("interface", "x"), ("orchestrator", "x"), ("x", "shared"), ("x", "y"))] == ["routes-to", "orchestrates", "uses", "collaborates-with"]
    kinds = spark.createDataFrame([("a", "shared"), ("b", "interface")], "id string, kind string")
    assert [tuple(r) for r in K.oriented(spark.createDataFrame([("a", "b", 2), ("b", "a", 3)], "source string, target string, weight long"), kinds).collect()] == [("b", "a", "routes-to", 5)]


def test_names(spark):
    units = spark.createDataFrame([("com.acme.orderFlow", 4, 0, 2), ("com.acme.stock", 4, 0, 1), ("com.acme.log", 1, 0, 0)], "unit string, methods long, endpoints long, traffic long")
    layout = units.withColumn("container", F.when(F.col("unit") == "com.acme.log", "l").otherwise("c"))
    assert {r["container"]: r["name"] for r in K.container_names(layout, units, "com.acme").collect()} == {"c": "Order Flow and Stock", "l": "Log"}


def edge(a, b, w, kind="uses"):
    return {"source": a, "target": b, "weight": w, "kind": kind}


def test_reduction_keeps_strong_direct_edges():
    weak, strong = edge("a", "c", 2), edge("a", "c", 9)
    chain = [edge("a", "b", 3), edge("b", "c", 3)]
    assert K.reduced([*chain, weak]) == chain and K.reduced([*chain, strong]) == [*chain, strong]
    layers = [edge("a", "b", 1, "builds-on"), edge("b", "c", 1, "builds-on"), edge("a", "c", 9, "builds-on")]
    assert K.reduced(layers) == layers[:2]


def test_readable_edges_are_bounded(spark):
    star = [edge("hub", f"n{k}", 20 - k) for k in range(10)]
    assert len(K.readable(star)) == 10  # too few within the degree bound, so the bound is dropped
    grid = [edge(f"a{i}", f"b{j}", 50 - 10 * i - j) for i in range(5) for j in range(5)]
    got = K.readable(grid)
    assert len(got) <= 12 and got[0]["weight"] == 50
    many = spark.createDataFrame([(f"s{k}", "t", k) for k in range(6)], "source string, target string, weight long")
    assert {r["source"] for r in K.shared_fan_in(many, 3).collect()} == {"s3", "s4", "s5"}
