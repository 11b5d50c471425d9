"""Registered queries over the star-schema graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.api import Catalog, query
from quiver.operators import analysis as A
from quiver.operators import architecture as K
from quiver.operators.traverse import connected_components, subgraph
from quiver.sources.graph import EdgeTable, PropertyGraph, collapse_parallel_edges, from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def cypher(name: str, text: str, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf: query(spark, from_tables(spark, sf), text)
    if sql:
        ORACLE_SQL[name] = sql


def frame(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


NEXT = "SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"

cypher("c01_match_filter_group", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN c.segment AS segment, count(*) AS n, round(sum(o.totalprice)) AS total ORDER BY segment", "SELECT c_mktsegment AS segment, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
cypher("c02_bound_variable", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MATCH (r {name: 'ASIA'}) RETURN n.name AS nation", "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
cypher("c03_two_hops", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE p.size >= 40 RETURN c.segment AS segment, count(*) AS n, sum(l.quantity) AS quantity", "SELECT c_mktsegment AS segment, count(*) AS n, sum(l_quantity) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size >= 40 GROUP BY 1")
cypher("c04_directions", "MATCH (r:Region)<-[:IN_REGION]-(n)--(x) RETURN r.name AS region, count(*) AS n", "WITH links AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN links ON k = n_nationkey GROUP BY 1")
cypher("c05_type_alternation", "MATCH (a)-[r:PLACED|IN_REGION]->(b) RETURN type(r) AS kind, count(*) AS n", "SELECT 'PLACED' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'IN_REGION', count(*) FROM nation")
cypher("c06_varlen_2_5", "MATCH (a:Event)-[:NEXT*2..5]->(b:Event) RETURN a.id AS a, b.id AS b", f"WITH RECURSIVE e AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL), w AS (SELECT src, dst, 1 AS d FROM e UNION ALL SELECT w.src, e.dst, d + 1 FROM w JOIN e ON e.src = w.dst WHERE d < 5) SELECT src + 8000000 AS a, dst + 8000000 AS b FROM w WHERE d >= 2")
cypher("c06_varlen_zero", "MATCH (n:Nation)-[*0..1]->(x) RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM nation")
cypher("c07_comma_patterns", "MATCH (r:Region), (n:Nation) WHERE n.name < 'NATION_12' RETURN r.name AS region, n.name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_name < 'NATION_12'")
cypher("c08_bound_target", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
cypher("c09_named_path", "MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN length(p) AS hops, size(nodes(p)) AS nodes, count(*) AS n", "SELECT 2 AS hops, 3 AS nodes, count(*) AS n FROM customer")
cypher("c10_optional_match", "MATCH (o:Order) OPTIONAL MATCH (o)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 45 RETURN o.priority AS priority, count(*) AS n, count(p) AS parts", "SELECT o_orderpriority AS priority, count(*) AS n, count(l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1")
cypher("c10_optional_only", "MATCH (o:Order) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) WITH o, count(p) AS k WHERE k = 0 RETURN o.id AS id", "SELECT o_orderkey + 6000000 AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
cypher("c13_return_star", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH n.name AS nation, r.name AS region RETURN *", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
cypher("c14_distinct", "MATCH (o:Order) RETURN DISTINCT o.status AS status, o.priority AS priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
cypher("c15_with_where", "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(*) AS n WHERE n > 10 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 10")
cypher("c16_unwind", "UNWIND range(1, 5) AS x UNWIND [x, x * 10] AS y RETURN x, y", "SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT unnest(range(1, 6)) AS x), unnest([x, x * 10]) t(y)")
cypher("c17_order_skip_limit", "MATCH (p:Part) RETURN p.id AS id, p.retailprice AS price ORDER BY p.retailprice DESC, p.id SKIP 5 LIMIT 20", "SELECT p_partkey + 5000000 AS id, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
cypher("c20_union", "MATCH (c:Customer) RETURN c.segment AS x UNION MATCH (o:Order) RETURN o.status AS x", "SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderstatus FROM orders")
cypher("c20_union_all", "MATCH (r:Region) RETURN r.name AS x UNION ALL MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
cypher("a01_aggregates", "MATCH (e:Event) RETURN e.kind AS kind, count(e) AS n, count(DISTINCT e.user) AS users, round(sum(e.value)) AS total, round(avg(e.value) * 1000) AS mean, min(e.value) AS low, max(e.value) AS high", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, floor(sum(value) + 0.5) AS total, floor(avg(value) * 1000 + 0.5) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
cypher("a04_empty_sum", "MATCH (e:Event) WHERE e.value < -1 RETURN sum(e.value) AS total, count(*) AS n, avg(e.value) AS mean", "SELECT 0.0::DOUBLE AS total, 0::BIGINT AS n, NULL::DOUBLE AS mean")
cypher("a09_percentiles", "MATCH (o:Order) RETURN o.priority AS priority, percentileCont(o.totalprice, 0.25) AS cont, percentileDisc(o.totalprice, 0.25) AS disc", "SELECT o_orderpriority AS priority, quantile_cont(o_totalprice, 0.25) AS cont, quantile_disc(o_totalprice, 0.25) AS disc FROM orders GROUP BY 1")
cypher("a11_deviation", "MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, round(stDev(s.acctbal)) AS sd, round(stDevP(s.acctbal)) AS sdp, count(*) + 1 AS more", "SELECT n_name AS nation, CASE WHEN count(*) >= 2 THEN floor(stddev_samp(s_acctbal) + 0.5) END AS sd, CASE WHEN count(*) >= 2 THEN floor(stddev_pop(s_acctbal) + 0.5) END AS sdp, count(*) + 1 AS more FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
cypher("f01_strings", "MATCH (n:Nation) RETURN toLower(n.name) AS low, left(n.name, 3) AS l, right(n.name, 2) AS r, substring(n.name, 2, 3) AS mid, replace(n.name, 'NATION', 'N') AS rep, size(n.name) AS k, reverse(n.name) AS rev, split(n.name, '_')[1] AS tail, trim('  x ') AS t", "SELECT lower(n_name) AS low, left(n_name, 3) AS l, right(n_name, 2) AS r, substr(n_name, 3, 3) AS mid, replace(n_name, 'NATION', 'N') AS rep, CAST(length(n_name) AS INT) AS k, reverse(n_name) AS rev, split_part(n_name, '_', 2) AS tail, 'x' AS t FROM nation")
cypher("f02_numbers", "MATCH (p:Part) RETURN p.id AS id, abs(-p.size) AS a, floor(p.retailprice) AS f, ceil(p.retailprice) AS c, sign(p.size - 25) AS s, toInteger(p.retailprice) AS i, toString(p.size) AS t, p.size % 7 AS m, p.size / 4 AS d, round(sqrt(p.size) * 100) AS q", "SELECT p_partkey + 5000000 AS id, p_size AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, CAST(sign(p_size - 25) AS INT) AS s, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, p_size % 7 AS m, p_size / 4 AS d, floor(sqrt(p_size) * 100 + 0.5) AS q FROM part")
cypher("f03_predicates", "MATCH (p:Part) WHERE (p.name CONTAINS '1' OR p.brand ENDS WITH '3') AND NOT p.name STARTS WITH 'x' AND p.brand =~ 'Brand#[1-3].*' AND p.size IN [1, 5, 10, 20] AND p.type IS NOT NULL RETURN p.id AS id", "SELECT p_partkey + 5000000 AS id FROM part WHERE (contains(p_name, '1') OR p_brand LIKE '%3') AND NOT p_name LIKE 'x%' AND regexp_full_match(p_brand, 'Brand#[1-3].*') AND p_size IN (1, 5, 10, 20)")
cypher("f04_lists", "UNWIND [1, 2, 3, 4] AS x RETURN x, size([i IN range(1, x) WHERE i % 2 = 1 | i * i]) AS odd, last([i IN range(1, x) WHERE i % 2 = 1 | i * i]) AS top, any(i IN range(1, x) WHERE i > 2) AS a, all(i IN range(1, x) WHERE i < 4) AS b, none(i IN range(1, x) WHERE i = 3) AS o, single(i IN range(1, x) WHERE i = 2) AS s, head(range(x, 9)) AS h, last([x, 7]) AS l, size(tail(range(1, x))) AS t, range(1, 9, 2)[x] AS r, size([1, 2, 3, 4][1..x]) AS sl, size(range(x, 1)) AS back", "SELECT x, CAST(ceil(x / 2) AS INT) AS odd, CAST(CASE WHEN x <= 2 THEN 1 ELSE 9 END AS BIGINT) AS top, x > 2 AS a, x < 4 AS b, x < 3 AS o, x >= 2 AS s, CAST(x AS BIGINT) AS h, 7 AS l, x - 1 AS t, CAST(1 + 2 * x AS BIGINT) AS r, x - 1 AS sl, CASE WHEN x = 1 THEN 1 ELSE 0 END AS back FROM (SELECT unnest([1, 2, 3, 4]) AS x)")
cypher("f05_case", "MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o.totalprice > 200000 THEN 1 ELSE 0 END AS big, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big, count(*) AS n FROM orders GROUP BY 1, 2")
cypher("f06_graph_functions", "MATCH (r:Region) RETURN id(r) AS id, elementId(r) AS element, qualifiedId(r) AS qualified, r.graphId AS graph, graphId(r) AS owner, labels(r)[0] AS label, size(keys(r)) AS k, keys(r)[1] AS second, r.unknown IS NULL AS missing, exists(r.name) AS there, properties(r) AS p, type(r) IS NULL AS no_type, size(keys({a: 1, b: 2})) AS own", """SELECT r_regionkey + 1000000 AS id, 'main:' || (r_regionkey + 1000000) AS element, 'main:' || (r_regionkey + 1000000) AS qualified, 'main' AS graph, 'main' AS owner, 'Region' AS label, 2 AS k, 'name' AS second, true AS missing, true AS there, '{"id":' || (r_regionkey + 1000000) || ',"name":"' || r_name || '"}' AS p, true AS no_type, 2 AS own FROM region""")
cypher("f07_math", "MATCH (p:Part) RETURN p.id AS id, round(exp(p.size / 25.0) * 1000) AS ex, round(log(p.size) * 1000) AS ln, round(log10(p.size) * 1000) AS lg, round(sin(p.size) * 1000) AS si, round(cos(p.size) * 1000) AS co, round(tan(p.size / 50.0) * 1000) AS ta, round(asin(p.size / 50.0) * 1000) AS asi, round(acos(p.size / 50.0) * 1000) AS aco, round(atan(p.size) * 1000) AS ata, round(atan2(p.size, 3) * 1000) AS at2, round(cot(p.size / 50.0) * 1000) AS ct, round(degrees(p.size)) AS de, round(radians(p.size) * 1000) AS ra, round(pi() * 1000) AS pie, round(e() * 1000) AS eu, p.size ^ 2 AS sq, rand() < 1 AS r, round(-p.size - 0.5) AS down", "SELECT p_partkey + 5000000 AS id, floor(exp(p_size / 25.0) * 1000 + 0.5) AS ex, floor(ln(p_size) * 1000 + 0.5) AS ln, floor(log10(p_size) * 1000 + 0.5) AS lg, floor(sin(p_size) * 1000 + 0.5) AS si, floor(cos(p_size) * 1000 + 0.5) AS co, floor(tan(p_size / 50.0) * 1000 + 0.5) AS ta, floor(asin(p_size / 50.0) * 1000 + 0.5) AS asi, floor(acos(p_size / 50.0) * 1000 + 0.5) AS aco, floor(atan(p_size) * 1000 + 0.5) AS ata, floor(atan2(p_size, 3) * 1000 + 0.5) AS at2, floor(cot(p_size / 50.0) * 1000 + 0.5) AS ct, floor(degrees(CAST(p_size AS DOUBLE)) + 0.5) AS de, floor(radians(CAST(p_size AS DOUBLE)) * 1000 + 0.5) AS ra, 3142.0::DOUBLE AS pie, 2718.0::DOUBLE AS eu, CAST(p_size * p_size AS DOUBLE) AS sq, true AS r, CAST(-p_size AS DOUBLE) AS down FROM part")
cypher("f08_nulls", "MATCH (r:Region) RETURN r.id AS id, r.u = r.v AS same, r.u <> r.v AS other, r.name = r.u AS one, null = null AS lits, r.u IS NULL AS n, r.name IS NOT NULL AS nn, 5 % 0 AS m, r.u STARTS WITH 'x' AS st, NOT (r.u = 'a') AS no, r.u IS NULL OR r.name = r.u AS o3, r.u IS NOT NULL AND r.name = r.u AS a3, size(r.u) IS NULL AS s, log(-1) = log(-1) AS nan, sqrt(r.u) IS NULL AS q", "SELECT r_regionkey + 1000000 AS id, true AS same, false AS other, NULL::BOOLEAN AS one, true AS lits, true AS n, true AS nn, NULL::INT AS m, NULL::BOOLEAN AS st, NULL::BOOLEAN AS no, true AS o3, false AS a3, true AS s, true AS nan, true AS q FROM region")
cypher("f09_conversions", "MATCH (n:Nation) RETURN n.id AS id, toUpper(toLower(n.name)) AS up, lTrim('  a ') AS l, rTrim('  a ') AS r, toFloat('1.5') AS f, toFloat('x') AS nf, toBoolean('TRUE') AS b, toBoolean('yes') AS nb, toInteger('12') AS i, toInteger('3.7') AS ni, toInteger(true) AS ib, toString(1.5) AS s, coalesce(n.u, n.name) AS c, timestamp() > 0 AS t, n.name + '!' AS cat, size([1] + 2) AS app, n.name[0] AS c0, n.name[1..3] AS sub, 0x1F + 0o17 AS lit, -(-3) AS neg, 'a' IN ['a', 'b'] AS has, 42 = '42' AS mixed, true XOR false AS x", "SELECT n_nationkey + 2000000 AS id, upper(n_name) AS up, 'a ' AS l, '  a' AS r, 1.5::DOUBLE AS f, NULL::DOUBLE AS nf, true AS b, NULL::BOOLEAN AS nb, 12::BIGINT AS i, NULL::BIGINT AS ni, 1::BIGINT AS ib, '1.5' AS s, n_name AS c, true AS t, n_name || '!' AS cat, 2 AS app, n_name[1] AS c0, substr(n_name, 2, 2) AS sub, 46 AS lit, 3 AS neg, true AS has, true AS mixed, true AS x FROM nation")
cypher("c07_theta", "MATCH (a:Nation), (b:Nation) WHERE a.id < b.id AND left(a.name, 8) = left(b.name, 8) RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND left(a.n_name, 8) = left(b.n_name, 8)")
cypher("c09_path_over_walk", "MATCH p = (a:Event)-[:NEXT*2..4]->(b:Event) WHERE a.id % 40 = 0 RETURN a.id AS a, b.id AS b, length(p) AS n, p.length AS n2, size(nodes(p)) AS k, nodes(p)[1].id AS second, nodes(p)[-2].id AS last_but_one, nodes(p)[1].label AS label, size(relationships(p)) AS r, relationships(p)[0].dst AS d, relationships(p)[1].type AS t", f"WITH e AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL), w2 AS (SELECT x.src AS a, x.dst AS m1, y.dst AS m2 FROM e x JOIN e y ON y.src = x.dst WHERE x.src % 40 = 0), w3 AS (SELECT w2.*, e.dst AS m3 FROM w2 JOIN e ON e.src = m2), w4 AS (SELECT w3.*, e.dst AS m4 FROM w3 JOIN e ON e.src = m3), every AS (SELECT a, m2 AS b, 2 AS n, m1, m1 AS before FROM w2 UNION ALL SELECT a, m3, 3, m1, m2 FROM w3 UNION ALL SELECT a, m4, 4, m1, m3 FROM w4) SELECT a + 8000000 AS a, b + 8000000 AS b, n, n AS n2, n + 1 AS k, m1 + 8000000 AS second, before + 8000000 AS last_but_one, 'Event' AS label, n AS r, m1 + 8000000 AS d, 'NEXT' AS t FROM every")
cypher("c09_path_backward", "MATCH (r:Region) WHERE r.name = 'ASIA' MATCH p = (c:Customer)-[*1..2]->(r) RETURN c.id AS c, size(nodes(p)) AS k, nodes(p)[0].id AS first, nodes(p)[1].label AS mid", "SELECT c_custkey + 3000000 AS c, 3 AS k, c_custkey + 3000000 AS first, 'Nation' AS mid FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
cypher("c16_unwind_nothing", "MATCH (r:Region) UNWIND r.unknown AS x RETURN r.name AS name UNION ALL UNWIND 5 AS z RETURN 'never' AS name UNION ALL MATCH (r:Region) UNWIND [r.name, 'x'] AS name RETURN name", "SELECT r_name AS name FROM region UNION ALL SELECT 'x' FROM region")
cypher("c22_statements", "RETURN 1 AS x; MATCH (r:Region) RETURN r.name + ';' AS name", "SELECT r_name || ';' AS name FROM region")
cypher("a07_collect", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS region, size(collect(n.name)) AS k, size(collect(DISTINCT left(n.name, 8))) AS d, collect(DISTINCT n.name)[0] AS first, size(collect(n.unknown)) AS none, count(DISTINCT n.unknown) AS nulls", "SELECT r_name AS region, CAST(count(*) AS INT) AS k, CAST(count(DISTINCT left(n_name, 8)) AS INT) AS d, min(n_name) AS first, 0 AS none, 0::BIGINT AS nulls FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
cypher("a09_percentile_disc", "MATCH (o:Order) RETURN o.priority AS priority, o.status AS status, percentileDisc(o.totalprice, 0.9) AS p90, percentileDisc(o.totalprice) AS median, percentileCont(o.totalprice, 0.1) AS p10", "SELECT o_orderpriority AS priority, o_orderstatus AS status, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.1) AS p10 FROM orders GROUP BY 1, 2")


def _catalog(spark: SparkSession, sf: str) -> Catalog:
    """Two graphs: orders with even keys and with odd keys."""
    whole, catalog = from_tables(spark, sf), Catalog(spark)
    for name, rest in (("even", 0), ("odd", 1)):
        nodes = {**whole.nodes, "Order": whole.nodes["Order"].where(F.col("id") % 2 == rest)}
        placed, inside = whole.edges["PLACED"], whole.edges["CONTAINS"]
        edges = {"PLACED": EdgeTable(placed.frame.where(F.col("dst") % 2 == rest), placed.source, placed.target), "CONTAINS": EdgeTable(inside.frame.where(F.col("src") % 2 == rest), inside.source, inside.target)}
        catalog.register(name, PropertyGraph(nodes, edges))
    return catalog


@frame("m01_cross_graph", "SELECT o_orderstatus AS status, count(*) AS n, CASE WHEN count(DISTINCT o_orderkey % 2) = 2 THEN 'even,odd' WHEN min(o_orderkey % 2) = 0 THEN 'even' ELSE 'odd' END AS graphs FROM orders GROUP BY 1")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    out = _catalog(spark, sf).query("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.status AS status, count(*) AS n")
    return out.select("status", "n", F.array_join("graph_ids", ",").alias("graphs"))


@frame("m04_fan_out", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS graph_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).fan_out("MATCH (o:Order) RETURN o.status AS status, count(*) AS n").drop("truncated")


@frame("a14_stats", "SELECT 'main' AS graph_id, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events) - (SELECT count(DISTINCT user_id) FROM events) AS edges, 0::BIGINT AS methods, 0::BIGINT AS call_sites")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    c = Catalog(spark)
    c.register("main", from_tables(spark, sf))
    return c.stats()


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as call sites: segments call priorities, customers call statuses."""
    o, c = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("caller_class"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("caller_name"), F.col("o_orderpriority").alias("callee_class"), F.col("o_orderstatus").alias("callee_name"), F.dayofmonth("o_orderdate").alias("line"))


CALLS = "SELECT o_orderkey AS id, c_mktsegment AS caller_class, 'c' || c_custkey AS caller_name, o_orderpriority AS callee_class, o_orderstatus AS callee_name FROM orders JOIN customer ON o_custkey = c_custkey"


@frame("s05_call_site_search", f"SELECT id FROM ({CALLS}) WHERE starts_with(callee_class, '1-') AND regexp_full_match(callee_name, '[FO]')")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    return call_sites(spark, sf).where(A.method_pattern(cls="1-*", name="[FO]")).select("id")


@frame("a13_overview_edges", f"WITH c AS ({CALLS}), top AS (SELECT x FROM (SELECT caller_class AS x FROM c UNION ALL SELECT callee_class FROM c) GROUP BY x ORDER BY count(*) DESC, x LIMIT 6) SELECT caller_class AS source, callee_class AS target, count(*) AS weight FROM c WHERE caller_class IN (FROM top) AND callee_class IN (FROM top) AND caller_class <> callee_class GROUP BY 1, 2")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_overview(call_sites(spark, sf), 6)[1]


@frame("g14_unreferenced", "SELECT c_name AS method FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    called = o.where("o_totalprice > 300000").join(c, o.o_custkey == c.c_custkey).select(F.col("c_name").alias("callee"))
    return A.unreferenced_methods(c.select(F.col("c_name").alias("method")), called)


def _next(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = from_tables(spark, sf)
    return g.nodes["Event"], g.edges["NEXT"].frame


WALK = f"WITH RECURSIVE e AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL), w AS (SELECT event_id AS s, event_id AS u, 0 AS d FROM events WHERE event_type = 'purchase' UNION ALL SELECT s, {{to}}, d + 1 FROM w JOIN e ON {{at}} = u WHERE d < 50)"


@frame("g01_backward_slice", WALK.format(to="src", at="dst") + " SELECT s + 8000000 AS start, u + 8000000 AS source, d AS depth FROM w JOIN events ON event_id = u WHERE event_type = 'signup'")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _next(spark, sf)
    return A.backward_slice(edges, nodes.where("kind = 'purchase'"), nodes.where("kind = 'signup'"))


@frame("g02_forward_slice", WALK.format(to="dst", at="src") + " SELECT s + 8000000 AS start, u + 8000000 AS sink, d AS depth FROM w JOIN events ON event_id = u WHERE event_type = 'error'")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _next(spark, sf)
    return A.forward_slice(edges, nodes.where("kind = 'purchase'"), nodes.where("kind = 'error'"))


@frame("g13_dead_methods", f"WITH RECURSIVE calls AS (SELECT src, dst FROM ({NEXT}) WHERE dst IS NOT NULL), dead AS (SELECT dst FROM calls JOIN events ON event_id = src WHERE event_type = 'signup' UNION SELECT calls.dst FROM calls JOIN dead ON calls.src = dead.dst) SELECT CAST(dst + 8000000 AS VARCHAR) AS method FROM dead")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _next(spark, sf)
    calls = edges.select(F.col("src").alias("id"), F.col("src").cast("string").alias("caller"), F.col("dst").cast("string").alias("callee"))
    return A.dead_methods(calls, nodes.where("kind = 'signup'").select("id"))


@frame("g16_subgraph_nodes", "SELECT n_nationkey + 2000000 AS id, 1 AS dist FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 1000002, 0")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    g = from_tables(spark, sf)
    return subgraph(g.edges["IN_REGION"].frame, g.nodes["Region"].where("id = 1000002").select("id"), depth=1)[0]


@frame("s09_supertypes", "SELECT c_custkey + 3000000 AS s, n_nationkey + 2000000 AS u, 1 AS dist FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey + 3000000, n_regionkey + 1000000, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    g = from_tables(spark, sf)
    return A.supertypes(g.edges["IN_NATION"].frame.unionByName(g.edges["IN_REGION"].frame), g.nodes["Customer"])


@frame("k08_components", "SELECT n_nationkey + 2000000 AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) * 0 + n_regionkey + 1000000 AS component FROM nation UNION ALL SELECT r_regionkey + 1000000, r_regionkey + 1000000 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(from_tables(spark, sf).edges["IN_REGION"].frame)


@frame("k07_traffic", f"SELECT least(caller_class, callee_class) AS a, greatest(caller_class, callee_class) AS b, count(*) AS weight FROM ({CALLS}) GROUP BY 1, 2")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    return K.traffic(call_sites(spark, sf).select(F.col("caller_class").alias("source"), F.col("callee_class").alias("target")))


@frame("s22_collapse_parallel", "SELECT l_orderkey + 6000000 AS src, l_partkey + 5000000 AS dst, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def s22(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_parallel_edges(from_tables(spark, sf).edges["CONTAINS"].frame, "price").select("src", "dst", "price")


@frame("s19_artifact_dependencies", f"SELECT left(caller_class, 1) AS source, left(callee_class, 1) AS target, count(*) AS weight FROM ({CALLS}) GROUP BY 1, 2")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    calls = call_sites(spark, sf)
    names = calls.select(F.explode(F.array("caller_class", "callee_class")).alias("class")).distinct()
    return A.artifact_dependencies(calls.select(F.col("caller_class").alias("from_class"), F.col("callee_class").alias("to_class")), names.select("class", F.substring("class", 1, 1).alias("artifact")))


@frame("g11_dead_branches", "SELECT e.event_id + 8000000 AS condition_id, CASE WHEN p_size > 25 THEN 'BRANCH_FALSE' ELSE 'BRANCH_TRUE' END AS kind FROM events e JOIN part ON p_partkey = e.event_id")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = _next(spark, sf)
    p = spark.read.parquet(f"{sf}/part.parquet")
    none = F.array().cast("array<long>")
    scopes = nodes.select(F.col("id").alias("condition_id"), F.lit("m").alias("method"), F.lit("GT").alias("op"), F.lit(25).alias("comparand"), none.alias("true_ids"), none.alias("false_ids"))
    assumed = p.select((F.col("p_partkey") + 5_000_000).alias("id"), F.col("p_size").alias("value"))
    flow = p.select((F.col("p_partkey") + 5_000_000).alias("src"), (F.col("p_partkey") + 8_000_000).alias("dst"))
    return A.dead_branches(assumed, flow, scopes).select("condition_id", "kind")
