"""Conformance on a small program graph, parser shapes, and multi-graph queries."""

import re

import pytest
from pyspark.sql import functions as F

from quiver import Catalog, PropertyGraph, query
from quiver.api import render_rows, write_rows
from quiver.plans.parser import CypherError, parse, render
from quiver.sources.graph import EdgeTable
from quiver.sources.program import glob_pattern

@pytest.fixture(scope="module")
def graph(spark):
    """A lending library: authors wrote books, books have copies, readers borrow copies and pass them on."""
    make = spark.createDataFrame
    nodes = {
        "Author": make([(10, "Ada", 1815), (11, "Blaise", 1623)], "id long, name string, born int"),
        "Novel": make([(20, "Tides", 310), (21, "Embers", 95)], "id long, title string, pages int"),
        "Atlas": make([(22, "Rivers", 64)], "id long, title string, pages int"),
        "Copy": make([(30, True), (31, False), (32, True)], "id long, worn boolean"),
        "Reader": make([(40, "Cy"), (41, "Dee"), (42, "Eve"), (43, "Fay")], "id long, name string"),
    }
    edges = {
        "WROTE": EdgeTable(make([(10, 20), (10, 21), (11, 22)], "src long, dst long"), "Author", None),
        "HAS": EdgeTable(make([(20, 30), (20, 31), (22, 32)], "src long, dst long"), None, "Copy"),
        "LENT": EdgeTable(make([(30, 40, 14), (31, 40, 7), (32, 43, 21)], "src long, dst long, days int"), "Copy", "Reader"),
        "PASSED": EdgeTable(make([(40, 41, "mail"), (41, 42, "hand"), (42, 40, "hand"), (40, 42, "mail"), (40, 42, "hand")], "src long, dst long, how string"), "Reader", "Reader"),
    }
    return PropertyGraph(nodes, edges, "main", {"Book": ["Novel", "Atlas"]})


CASES = [
    ("MATCH (a:Author {born: 1815})-[*1..2]->(b) RETURN b.id AS x", {20, 21, 30, 31}),
    ("MATCH (a:Author {born: 1815})-[*2]->(b) RETURN b.id AS x", {30, 31}),
    ("MATCH (a:Author), (b:Atlas) RETURN a.born AS x", {1815, 1623}),
    ("MATCH (n:Copy) RETURN count(*) AS x", {3}),
    ("MATCH (n:Novel) RETURN n.pages AS x ORDER BY x ASC SKIP 1 LIMIT 2", {310}),
    ("UNWIND [4, 5, 6] AS x WITH x WHERE x > 4 RETURN x", {5, 6}),
    ("MATCH (n:Novel:Copy) RETURN n.id AS x", set()),
    ("MATCH (n:Novel {pages: 95}) OPTIONAL MATCH (n)-[:HAS]->(m) RETURN m.id AS x", {None}),
    ("MATCH (n:Book) RETURN n.id AS x", {20, 21, 22}),
    ("MATCH (a)-[r:PASSED {how: 'mail'}]->(b:Reader) RETURN b.name AS x", {"Dee", "Eve"}),
    ("MATCH (a {id: 42})<-[:PASSED]-(b) RETURN b.id AS x", {40, 41}),
    ("MATCH (a {id: 41})--(b) RETURN b.id AS x", {40, 42}),
    ("MATCH (n) WHERE n.nothing IS NULL RETURN count(n) AS x", {12}),
    ("MATCH p = (a {id: 11})-[:WROTE]->()-[:HAS]->(c) RETURN length(p) AS x", {2}),
    ("MATCH (n:Novel) WHERE n.pages < 0 RETURN sum(n.pages) AS x", {0.0}),
    ("MATCH p = (a {id: 30})-[:LENT|PASSED*2..3]->(b {id: 42}) UNWIND nodes(p) AS n RETURN n.id AS x", {30, 40, 41, 42}),
    ("MATCH p = (a {id: 30})-[*0..1]->(b) RETURN size(nodes(p)) - size(relationships(p)) AS x", {1}),
    ("MATCH (b {id: 42}) MATCH p = (a {id: 31})-[*3..3]->(b) RETURN nodes(p)[0].id AS x", {31}),
    ("MATCH (a:Copy), (b:Copy) WHERE a.unknown = b.missing RETURN count(*) AS x", {9}),
    ("RETURN null = null AS x", {True}),
    ("RETURN null <> 1 AS x", {None}),
    ("UNWIND null AS x RETURN x", set()),
    ("RETURN log(-2) = log(-3) AS x", {True}),
    ("RETURN sqrt('text') AS x", {None}),
    ("RETURN size(keys({a: 1, b: 2})) AS x", {2}),
    ("MATCH (r:Reader) RETURN percentileDisc(r.id, 0.5) AS x", {41.0}),
    ("RETURN round(-2.5) AS x", {-2.0}),
    ("RETURN substring('lending', 1, 3) AS x", {"end"}),
    ("RETURN split('x|y|z', '|')[2] AS x", {"z"}),
    ("RETURN toInteger('9.9') AS x", {None}),
    ("RETURN 'lend' =~ 'l.' AS x", {False}),
    ("RETURN 9 / 2 AS x", {4.5}),
    ("RETURN size(range(3, 1)) AS x", {0}),
    ("RETURN [6, 7, 8, 9][1..3][0] AS x", {7}),
    ("RETURN none(i IN [1, 2] WHERE i > 2) AS x", {True}),
    ("RETURN CASE WHEN null THEN 'a' ELSE 'b' END AS x", {"b"}),
    ("RETURN true XOR false AS x", {True}),
    ("RETURN 1 < 2 < 3 AS x", {True}),
    ("RETURN 0xFF AS x", {255}),
    ("MATCH (a:Novel) RETURN a.pages AS x UNION MATCH (a:Novel) RETURN a.pages AS x", {95, 310}),
]


@pytest.mark.parametrize(("text", "expected"), CASES, ids=[c[0][:60] for c in CASES])
def test_conformance(spark, graph, text, expected):
    assert {r["x"] for r in query(spark, graph, text).collect()} == expected


def test_rows_of_variable_length_keep_edge_multiplicity(spark, graph):
    assert query(spark, graph, "MATCH (a {id: 40})-[:PASSED*1..1]->(b) RETURN b.id AS x").count() == 3


def test_parameters_and_row_cap(spark, graph):
    assert query(spark, graph, "MATCH (n:Novel) WHERE n.pages = $v RETURN n.id AS x", {"v": 95}).collect()[0]["x"] == 21
    assert query(spark, graph, "MATCH (n) RETURN n.id AS x", max_rows=3).count() == 3


@pytest.mark.parametrize("text", ["CREATE (n) RETURN n", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n", "MERGE (n) RETURN n"])
def test_writes_are_refused(text):
    with pytest.raises(NotImplementedError):
        parse(text)


@pytest.mark.parametrize("text", ["MATCH (n", "RETURN", "MATCH (n)", "FOO"])
def test_bad_text_is_refused(text):
    with pytest.raises(CypherError):
        parse(text)


def test_column_names(spark, graph):
    assert query(spark, graph, "MATCH (n:Novel) RETURN n.title, count(*)").columns == ["n.title", "count(*)"]
    assert render(parse("RETURN a.b + 1")[0][0].items[0].expr) == "a.b + 1"


def test_several_graphs(spark, graph):
    c = Catalog(spark)
    for name, ids in (("north", [(5,), (50,)]), ("south", [(5,), (60,)])):
        nodes = {"N": spark.createDataFrame(ids, "id long")}
        c.register(name, PropertyGraph(nodes, {"E": EdgeTable(spark.createDataFrame([ids[0] + ids[1]], "src long, dst long"))}))
    got = {(r["x"], tuple(r["graph_ids"])) for r in c.query("MATCH (a)-[:E]->(b) RETURN b.id AS x").collect()}
    assert got == {(50, ("north",)), (60, ("south",))}
    assert [tuple(r["graph_ids"]) for r in c.query("MATCH (a) RETURN count(*) AS n").collect()] == [("north", "south")]
    with pytest.raises(ValueError):
        c.register("no/slash", graph)


def test_edges_of_a_node_are_listed_whole(spark):
    nodes = {"N": spark.range(3000)}
    star = EdgeTable(spark.range(1, 3000).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")), "N", "N")
    c = Catalog(spark)
    c.register("star", PropertyGraph(nodes, {"TO": star, "FROM": EdgeTable(star.frame.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "N", "N")}))
    assert [r["src"] for r in c.incoming("star", 0, ["to"]).collect()] == list(range(1, 3000))
    assert [r["dst"] for r in c.outgoing("star", 0).collect()] == list(range(1, 3000))
    assert c.incoming("star", 0, limit=2500).count() == 2500


COUNTED = [
    ("MATCH (c:Copy)-[:LENT]->(r:Reader), (s:Reader)-[:PASSED]->(r) RETURN r.name AS x, count(*) AS n", {"Cy": 2}),
    ("MATCH (c:Copy)-[:LENT]->(r)<-[:PASSED]-(s) RETURN r.name AS x, count(s) AS n", {"Cy": 2}),
    ("MATCH (a:Copy), (b:Copy), (r:Reader) RETURN 1 AS x, count(*) AS n", {1: 36}),
    ("MATCH (a:Novel {pages: 1}), (b:Copy) RETURN count(*) AS x, 0 AS n", {}),
    ("MATCH (a:Reader)-[:PASSED]->(b) MATCH (b)-[:PASSED]->(d) RETURN b.name AS x, count(*) AS n", {"Dee": 1, "Eve": 3, "Cy": 3}),
    ("MATCH (a:Reader)-[r:PASSED]->(b), (b)-[:PASSED]->(d) WHERE r.how = 'mail' RETURN b.name AS x, count(DISTINCT d.name) + max(d.id) - 42 AS n", {"Dee": 1, "Eve": -1}),
    ("MATCH (a:Reader)-[:PASSED]->(b), (b)-[:PASSED]->(d) WITH b, count(*) AS k MATCH (b)-[:PASSED]->(f) RETURN b.name AS x, sum(k) AS n", {"Dee": 1.0, "Eve": 3.0, "Cy": 9.0}),
    ("MATCH (a:Reader)-[:PASSED]->(b), (b)-[:PASSED]->(d) OPTIONAL MATCH (c:Copy)-[:LENT]->(b) RETURN b.name AS x, count(c) AS n", {"Dee": 0, "Eve": 0, "Cy": 6}),
    ("MATCH (a:Reader)-[:PASSED]->(b), (b)-[:PASSED]->(d) RETURN b.name AS x, sum(a.id) AS n", {"Dee": 40.0, "Eve": 121.0, "Cy": 126.0}),
    ("MATCH (a:Reader)-[:PASSED]->(b), (b)-[:PASSED]->(d) UNWIND [1, 2] AS t RETURN t AS x, count(*) AS n", {1: 7, 2: 7}),
]


@pytest.mark.parametrize(("text", "expected"), COUNTED, ids=[c[0][:60] for c in COUNTED])
def test_counted_matches(spark, graph, text, expected):
    assert {r["x"]: r["n"] for r in query(spark, graph, text).collect() if r["x"] != 0} == expected


def test_matches_are_counted_not_made(spark):
    nodes = {"Hub": spark.range(1), "Leaf": spark.range(1, 1_000_001), "Twig": spark.range(1, 1_000_001)}
    to_hub = spark.range(1, 1_000_001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    g = PropertyGraph(nodes, {"ON": EdgeTable(to_hub, "Leaf", "Hub"), "OF": EdgeTable(to_hub, "Twig", "Hub")})
    for text in ("MATCH (a:Leaf)-[:ON]->(h), (b:Twig)-[:OF]->(h) RETURN count(*) AS n", "MATCH (a:Leaf)-[:ON]->(h)<-[:OF]-(b) RETURN h.id AS id, count(b) AS n", "MATCH (a:Leaf), (b:Twig) RETURN count(*) AS n"):
        assert [r["n"] for r in query(spark, g, text).collect()] == [10**12]


@pytest.fixture(scope="module")
def crowded(spark):
    """Labels whose ids meet: cat 1 and dog 1 chase mouse 1, which lives in house 1; dog 1 guards house 1."""
    make = spark.createDataFrame
    nodes = {x: make([(1, x.lower()), (2, x.lower() + " two")], "id long, name string") for x in ("Cat", "Dog", "Mouse", "House")}
    chase = make([(1, 1, "Cat", "Mouse"), (1, 1, "Dog", "Mouse")], "src long, dst long, __from string, __to string")
    edges = {
        "CHASES": EdgeTable(chase.select("src", "dst"), None, "Mouse", chase),
        "LIVES_IN": EdgeTable(make([(1, 1)], "src long, dst long"), "Mouse", "House"),
        "GUARDS": EdgeTable(make([(1, 1)], "src long, dst long"), "Dog", "House"),
    }
    return PropertyGraph(nodes, edges)


CROWDED = [
    ("MATCH (a)-[r:LIVES_IN|GUARDS]->(b) RETURN type(r) + ' ' + a.name + ' ' + b.name AS x", ["GUARDS dog house", "LIVES_IN mouse house"]),
    ("MATCH (a)-[r:LIVES_IN|GUARDS]->(b) RETURN type(r) AS x", ["GUARDS", "LIVES_IN"]),
    ("MATCH (a)-[r:LIVES_IN|CHASES]->(b) RETURN a.name + ' ' + b.name AS x", ["cat mouse", "dog mouse", "mouse house"]),
    ("MATCH (a)-[:CHASES]->(b)-[:LIVES_IN]->(c) RETURN a.name + ' ' + labels(b)[0] + ' ' + c.name AS x", ["cat Mouse house", "dog Mouse house"]),
    ("MATCH (d:Dog)-[:CHASES]->(b) RETURN b.name AS x", ["mouse"]),
    ("MATCH (h:House) MATCH (a)-[:GUARDS]-(h) RETURN a.name AS x", ["dog"]),
    ("MATCH (c:Cat)-[*1..3]->(b) RETURN b.name AS x", ["house", "mouse"]),
    ("MATCH p = (c:Cat)-[*2..3]->(b) UNWIND nodes(p) AS n RETURN n.label AS x", ["Cat", "House", "Mouse"]),
    ("MATCH (h:House), (c:Cat {name: 'cat'}) MATCH (c)-[*1..3]->(h) RETURN h.name AS x", ["house"]),
    ("MATCH (a)-[r:CHASES]->(b:Mouse) RETURN size(keys(r)) AS x", [3, 3]),
]


@pytest.mark.parametrize(("text", "expected"), CROWDED, ids=[c[0][:60] for c in CROWDED])
def test_ids_of_different_labels_may_meet(spark, crowded, text, expected):
    assert sorted(r["x"] for r in query(spark, crowded, text).collect()) == expected


def test_labels_of_ends_are_kept(spark, crowded, tmp_path):
    text = "MATCH (a)-[r:CHASES|GUARDS]->(b) RETURN a.name + ' ' + b.name AS x"
    want = ["cat mouse", "dog house", "dog mouse"]
    crowded.save(str(tmp_path))
    for mode in ("mapped", "eager"):
        back = PropertyGraph.load(spark, str(tmp_path), mode=mode)
        assert sorted(r["x"] for r in query(spark, back, text).collect()) == want
        assert "__from" not in back.scan_edges(["CHASES"]).columns
        back.unpersist()
    c = Catalog(spark)
    c.register("one", crowded)
    c.register("two", PropertyGraph(crowded.nodes, {"CHASES": EdgeTable(crowded.edges["LIVES_IN"].frame, "Cat", "Mouse")}))
    assert sorted(r["x"] for r in c.query(text).collect()) == ["cat mouse", *want]


def test_round_trip(spark, graph, tmp_path):
    graph.save(str(tmp_path))
    for mode in ("mapped", "eager"):
        back = PropertyGraph.load(spark, str(tmp_path), mode=mode)
        assert query(spark, back, "MATCH (b:Book)-[:HAS]->(c) RETURN count(*) AS n").collect()[0]["n"] == 3
        assert back.edges["LENT"].target == "Reader"
        back.unpersist()
    assert list(PropertyGraph.load(spark, str(tmp_path), labels=["Copy"], types=["HAS"]).nodes) == ["Copy"]


def test_snapshots_are_kept_while_they_are_read(spark, graph):
    c = Catalog(spark)
    c.register("g", PropertyGraph(graph.nodes, graph.edges))
    with c.lease("g") as old:
        c.register("g", PropertyGraph({"Copy": graph.nodes["Copy"]}, graph.edges))
        assert old.replaced and not old.closed and c.versions["g"] == 2
    assert old.closed
    c.unload("g")
    assert c.graphs == {}


def test_rows_out(spark, graph, tmp_path):
    df = query(spark, graph, "MATCH (r:Reader) RETURN r, r.name AS name ORDER BY name")
    assert render_rows(df, 2).split("\n") == ["r\tname", '{"id":40,"name":"Cy","label":"Reader"}\tCy', '{"id":41,"name":"Dee","label":"Reader"}\tDee']
    for kind in ("json", "csv", "text"):
        write_rows(df, str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() >= 4
    with pytest.raises(ValueError):
        write_rows(df, str(tmp_path / "x"), "xml")


def test_globs():
    hits = lambda glob, *paths: [p for p in paths if re.match(glob_pattern(glob), p)]
    assert hits("**/*.yml", "a.yml", "x/y/a.yml", "a.xml", "x/ayml") == ["a.yml", "x/y/a.yml"]
    assert hits("conf/*.json", "conf/a.json", "conf/x/a.json") == ["conf/a.json"]
