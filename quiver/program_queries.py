"""Registered queries of program graphs: the star schema read as a program, each with the SQL that gives the same rows.

Segments are classes that call order priorities; customers are methods; nations extend regions; events are values that flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver import queries as Q
from quiver.api import Catalog, as_maps, property_filter, query, write_rows
from quiver.operators import analysis as A
from quiver.operators import architecture as K
from quiver.operators.traverse import cut, shared_folder, subgraph
from quiver.sources.graph import PropertyGraph, from_tables
from quiver.sources.program import Program, branch_scopes, functional_dispatch, resource_format, resource_links, resource_profile, resources, returned_targets

frame, CALLS, NEXT = Q.frame, Q.CALLS, Q.NEXT


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def program(spark: SparkSession, sf: str) -> Program:
    t = lambda name: table(spark, sf, name)
    c, n, s = t("customer"), t("nation"), t("supplier")
    methods = c.select(F.concat_ws(".", "c_mktsegment", "c_name").alias("method"), F.col("c_mktsegment").alias("class"), F.col("c_name").alias("name"), F.array(F.lit("int")).alias("params"), F.when(F.col("c_nationkey") < 10, "java.lang.Object").otherwise("N").alias("returns"))
    types = n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sub"), F.col("r_name").alias("super"), F.lit("EXTENDS").alias("kind")).union(t("region").select("r_name", F.lit("WORLD"), F.lit("IMPLEMENTS")))
    enums = n.select(F.lit("Nation").alias("class"), F.col("n_name").alias("name"), F.array(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("args"))
    notes = c.select(F.col("c_mktsegment").alias("class"), F.col("c_name").alias("member"), F.explode(F.when(F.col("c_nationkey") == 3, F.array(F.lit("Get"), F.lit("Safe"))).when(F.col("c_nationkey") == 4, F.array(F.lit("Get"))).otherwise(F.array().cast("array<string>"))).alias("name"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"))
    scopes = s.select((F.col("s_suppkey") + 4_000_000).alias("condition_id"), F.col("s_name").alias("method"), F.lit("EQ").alias("op"), F.col("s_nationkey").alias("comparand"), F.array().cast("array<long>").alias("true_ids"), F.array().cast("array<long>").alias("false_ids"))
    origins = n.select(F.col("n_name").alias("class"), F.concat(F.lit("libs/r"), F.col("n_regionkey").cast("string"), F.lit(".jar")).alias("artifact"))
    return Program(methods, Q.call_sites(spark, sf), types, enums, notes, scopes, origins)


METHODS = "SELECT c_mktsegment || '.' || c_name AS method, c_mktsegment AS class, c_name AS name, c_nationkey FROM customer"


def registered(spark: SparkSession, sf: str) -> Catalog:
    catalog = Catalog(spark)
    catalog.register("main", from_tables(spark, sf), program(spark, sf))
    return catalog


# stores
@frame("s02_node", "SELECT 2000007 AS id, n_name AS name, 'Nation' AS label FROM nation WHERE n_nationkey = 7")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return registered(spark, sf).node("main", 2_000_007).select("id", "name", "label")


@frame("s03_outgoing_incoming", "SELECT 'out' AS way, 'IN_REGION' AS type, 2000007 AS src, n_regionkey + 1000000 AS dst FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'in', 'IN_NATION', c_custkey + 3000000, 2000007 FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'in', 'IN_NATION', s_suppkey + 4000000, 2000007 FROM supplier WHERE s_nationkey = 7")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    c = registered(spark, sf)
    one = lambda df, way: df.select(F.lit(way).alias("way"), "type", "src", "dst")
    return one(c.outgoing("main", 2_000_007), "out").union(one(c.incoming("main", 2_000_007, ["in_nation"]), "in"))


@frame("s06_methods", f"SELECT method, name, (SELECT count(*) FROM ({METHODS}) WHERE class = 'BUILDING') AS methods FROM ({METHODS}) WHERE class = 'BUILDING' ORDER BY method LIMIT 7")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    p, test = program(spark, sf), A.method_pattern(cls="BUILDING", prefix="")
    return p.method_slice(7, test).select("method", "name").crossJoin(p.method_count(test))


@frame("s07_method_pattern", f"SELECT method FROM ({METHODS}) WHERE starts_with(class, 'B') AND regexp_full_match(name, '.*[02468]') AND c_nationkey = 3")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    return program(spark, sf).find_methods(A.method_pattern(cls="B*", name=".*[02468]", params=["int"], returns="java.lang.Object", prefix=""), annotated=["Get", "Safe"]).select("method")


@frame("s08_direct_types", "SELECT n_name AS type, r_name AS related, 'super' AS way FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, n_name, 'sub' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'WORLD', 'super' FROM region UNION ALL SELECT 'WORLD', r_name, 'sub' FROM region")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    p = program(spark, sf)
    every = p.hierarchy_types()
    return p.supertypes(every).withColumnRenamed("super", "related").withColumn("way", F.lit("super")).union(p.subtypes(every).withColumn("way", F.lit("sub")))


@frame("s09_all_supertypes", "SELECT n_name AS type, r_name AS super FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, 'WORLD' FROM nation")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    p = program(spark, sf)
    return p.supertypes(table(spark, sf, "nation").select(F.col("n_name").alias("type")), transitive=True)


@frame("s09_deep_closure", f"WITH RECURSIVE e AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL), w AS (SELECT event_id AS s, event_id AS u, 0 AS dist FROM events WHERE event_id % 97 = 0 UNION ALL SELECT s, dst, dist + 1 FROM w JOIN e ON src = u) SELECT s + 8000000 AS s, u + 8000000 AS u, dist FROM w WHERE dist > 0")
def s09_deep(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = Q._next(spark, sf)
    return A.supertypes(edges, nodes.where((F.col("id") - 8_000_000) % 97 == 0))


@frame("s10_enum_values", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) || ',' || n_regionkey AS args FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'NOWHERE', NULL")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "nation").where("n_nationkey < 5").select(F.lit("Nation").alias("class"), F.col("n_name").alias("name")).union(spark.createDataFrame([("Nation", "NOWHERE")], "class string, name string"))
    return program(spark, sf).enum_arguments(wanted).select("name", F.when(F.col("args").isNotNull(), F.array_join("args", ",")).alias("args"))


@frame("s11_member_annotations", """SELECT c_name AS member, CASE c_nationkey WHEN 3 THEN 2 ELSE 1 END AS n, '{"nation":"' || c_nationkey || '"}' AS attributes FROM customer WHERE c_nationkey IN (3, 4)""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return program(spark, sf).member_annotations().select("member", F.size("annotations").alias("n"), F.col("annotations")["Get"].alias("attributes"))


@frame("s12_branch_scopes", "SELECT s_suppkey + 4000000 AS condition_id, s_name AS method, 'EQ' AS op FROM supplier WHERE s_suppkey <= 3")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    return program(spark, sf).scopes_of(spark.range(4_000_000, 4_000_004)).select("condition_id", "method", "op")


@frame("s13_class_origins", "SELECT r_name AS class, NULL AS artifact FROM region UNION ALL SELECT n_name, 'libs/r' || n_regionkey || '.jar' FROM nation")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    p = program(spark, sf)
    return p.origin_of(p.hierarchy_types().where("type <> 'WORLD'").withColumnRenamed("type", "class"))


@frame("s14_program_stats", "SELECT 'main' AS graph_id, (SELECT count(*) FROM customer) AS methods, (SELECT count(*) FROM orders) AS call_sites")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return registered(spark, sf).stats().select("graph_id", "methods", "call_sites")


@frame("s16_resource_links", "SELECT n_nationkey AS src, c_custkey AS dst, 'OPENS' AS kind FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 UNION ALL SELECT n_nationkey, c_custkey, 'BUNDLE_CANDIDATE' FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 WHERE c_custkey % 3 = 1 UNION ALL SELECT n_nationkey, c_custkey, 'LOOKUP' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 2")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    # a bundle has a base file and files for locales; the nations of a region are its files
    place = F.concat(F.lit("text/r"), F.col("n_regionkey").cast("string"))
    files = n.select(F.col("n_nationkey").alias("id"), F.concat(place, F.lit("_"), F.translate(F.concat(F.substring("n_name", 8, 1), F.lpad(F.substring("n_name", 8, 2), 2, "0")), "0123456789", "abcdefghij"), F.lit(".properties")).alias("path"))
    path = files.select(F.col("id").alias("c_nationkey"), "path")
    calls = c.join(path, "c_nationkey")
    kind = F.col("c_custkey") % 3
    sites = calls.select(F.col("c_custkey").alias("id"), F.lit("text.Reader").alias("caller_class"), F.when(kind == 0, "java.lang.Class").otherwise("java.util.ResourceBundle").alias("callee_class"), F.when(kind == 0, "getResource").when(kind == 1, "getBundle").otherwise("getString").alias("callee_name"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("receiver"), F.when(kind == 0, F.regexp_replace("path", "^text/", "")).when(kind == 1, F.concat(F.lit("text.r"), (F.col("c_nationkey") % 5).cast("string"))).otherwise("key").alias("literal"))
    bound = path.select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("local"), "path")
    return resource_links(sites, files, bound)


@frame("s17_functional_dispatch", "SELECT DISTINCT o_orderkey AS unresolved_id, n_name AS callee, o_orderstatus AS caller FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_regionkey = o_orderkey % 5 AND n_nationkey % 2 = 0 WHERE o_orderkey % 50 = 0")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderkey % 50 = 0")
    calls = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("string").alias("method"), F.lit(0).alias("index"), F.col("o_orderstatus").alias("caller"))
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    passed = n.select(F.col("n_regionkey").cast("string").alias("callee"), F.lit(0).alias("index"), F.col("n_name").alias("target"))
    return functional_dispatch(calls, passed.union(passed).union(passed.withColumn("index", F.lit(1)))).select("unresolved_id", "callee", "caller")


@frame("s17_returned_targets", "SELECT c_name AS local, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s17b(spark: SparkSession, sf: str) -> DataFrame:
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    return returned_targets(n.select(F.col("n_nationkey").alias("method"), F.col("n_name").alias("target")), c.select(F.col("c_nationkey").alias("method"), F.col("c_name").alias("local")))


@frame("s18_branch_scopes", "WITH b AS (SELECT c_custkey AS condition_id, c_nationkey AS t, (c_nationkey + 5) % 25 AS f FROM customer), side AS (SELECT condition_id, 'BRANCH_TRUE' AS side, t AS a, f AS o FROM b UNION ALL SELECT condition_id, 'BRANCH_FALSE', f, t FROM b) SELECT condition_id, side, a + 2000000 AS id FROM side UNION ALL SELECT condition_id, side, x.n_regionkey + 1000000 FROM side JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = o WHERE x.n_regionkey <> y.n_regionkey")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    branches = c.select(F.col("c_custkey").alias("condition_id"), (F.col("c_nationkey") + 2_000_000).cast("long").alias("true_start"), ((F.col("c_nationkey") + 5) % 25 + 2_000_000).cast("long").alias("false_start"))
    return branch_scopes(from_tables(spark, sf).edges["IN_REGION"].frame, branches)


@frame("s20_resource_scan", "SELECT 'nation.parquet' AS path, 'text' AS format, true AS some UNION ALL SELECT 'region.parquet', 'text', true")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    found = resources(spark, sf, "*ion.parquet", 64).where("path in ('nation.parquet', 'region.parquet')")
    return found.select("path", "format", ((F.col("size") > 64) & (F.octet_length("content") == 64) & F.col("profile").isNull()).alias("some"))


@frame("s21_resource_format", "SELECT 'conf/application-' || lower(n_name) || e AS path, CASE e WHEN '.yml' THEN 'yaml' WHEN '.json' THEN 'json' WHEN '.properties' THEN 'properties' ELSE 'text' END AS format, CASE WHEN e <> '.txt' THEN lower(n_name) END AS profile FROM nation, (VALUES ('.yml'), ('.json'), ('.properties'), ('.txt')) v(e)")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.explode(F.array(*map(F.lit, (".yml", ".json", ".properties", ".txt"))))
    paths = table(spark, sf, "nation").select("n_name", ends.alias("e")).select(F.concat(F.lit("conf/application-"), F.lower("n_name"), "e").alias("path"))
    return paths.select("path", resource_format(F.col("path")).alias("format"), resource_profile(F.col("path")).alias("profile"))


def _stored(spark: SparkSession, sf: str, mode: str) -> PropertyGraph:
    import uuid

    whole = from_tables(spark, sf)
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    PropertyGraph({x: whole.nodes[x] for x in ("Customer", "Nation")}, {"IN_NATION": whole.edges["IN_NATION"]}).save(folder)
    return PropertyGraph.load(spark, folder, mode=mode)


for _name, _mode in (("s22_save_load", "mapped"), ("s23_load_eager", "eager")):
    Q.QUERIES[_name] = lambda spark, sf, mode=_mode: query(spark, _stored(spark, sf, mode), "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS n")
    Q.ORACLE_SQL[_name] = "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"


@frame("s24_row_sink", "SELECT n_name AS name, CAST(n_regionkey + 1000000 AS BIGINT) AS region FROM nation")
def s24(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    write_rows(query(spark, from_tables(spark, sf), "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.name AS name, r.id AS region"), folder, "csv")
    return spark.read.option("header", "true").schema("name string, region bigint").csv(folder)


@frame("s25_enricher", "SELECT count(*) AS n FROM customer WHERE c_acctbal < 0")
def s25(spark: SparkSession, sf: str) -> DataFrame:
    c = Catalog(spark)
    c.register_enricher(lambda g: PropertyGraph({**g.nodes, "Debtor": g.nodes["Customer"].where("acctbal < 0")}, g.edges))
    return query(spark, c.register("main", from_tables(spark, sf)), "MATCH (d:Debtor) RETURN count(*) AS n")


# queries by parameters, caps, and results
Q.QUERIES["c23_parameters"] = lambda spark, sf: query(spark, from_tables(spark, sf), "MATCH (p:Part {size: $s}) WHERE p.retailprice > $low RETURN p.id AS id", {"s": 7, "low": 1000.0})
Q.ORACLE_SQL["c23_parameters"] = "SELECT p_partkey + 5000000 AS id FROM part WHERE p_size = 7 AND p_retailprice > 1000"
Q.QUERIES["c25_row_cap"] = lambda spark, sf: query(spark, from_tables(spark, sf), "MATCH (p:Part) RETURN p.id AS id ORDER BY id LIMIT 50", max_rows=10)
Q.ORACLE_SQL["c25_row_cap"] = "SELECT p_partkey + 5000000 AS id FROM part ORDER BY 1 LIMIT 10"
Q.QUERIES["c26_result_nodes"] = lambda spark, sf: as_maps(query(spark, from_tables(spark, sf), "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE n.name < 'NATION_12' RETURN n, r"))
Q.ORACLE_SQL["c26_result_nodes"] = """SELECT '{"id":' || (n_nationkey + 2000000) || ',"name":"' || n_name || '","label":"Nation"}' AS n, '{"id":' || (r_regionkey + 1000000) || ',"name":"' || r_name || '","label":"Region"}' AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name < 'NATION_12'"""


@frame("c24_writes_refused", "SELECT unnest(['CREATE (n)', 'MATCH (n) DELETE n', 'MATCH (n) SET n.x = 1', 'MERGE (n)', 'MATCH (n) REMOVE n.x']) AS statement, true AS refused")
def c24(spark: SparkSession, sf: str) -> DataFrame:
    def refused(text: str) -> bool:
        try:
            query(spark, from_tables(spark, sf), text + " RETURN 1")
        except NotImplementedError:
            return True
        return False

    return spark.createDataFrame([(x, refused(x)) for x in ("CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1", "MERGE (n)", "MATCH (n) REMOVE n.x")], "statement string, refused boolean")


@frame("c28_property_filter", "SELECT p_partkey AS id FROM part WHERE p_size = 7 OR p_size > 45 AND p_name <> 'x' AND p_brand LIKE 'Brand%' AND contains(p_type, 'S') AND regexp_full_match(p_brand, '.*[1-3]') AND p_retailprice <= 1500")
def c28(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    f = lambda c, op, v: property_filter(F.col(c), op, v)
    rest = f("p_size", ">", 45) & f("p_name", "<>", "x") & f("p_brand", "STARTS WITH", "Brand") & f("p_type", "CONTAINS", "S") & f("p_brand", "=~", ".*[1-3]") & f("p_retailprice", "<=", 1500)
    return p.where(f("p_size", "=", 7.0) | rest).select(F.col("p_partkey").alias("id"))


# analyses
def flow(spark: SparkSession, sf: str) -> DataFrame:
    """NEXT as dataflow (src, dst, kind), its kind by the event that it leaves."""
    nodes, edges = Q._next(spark, sf)
    return edges.join(nodes.select(F.col("id").alias("src"), "kind"), "src").select("src", "dst", "kind")


KINDS = f"(SELECT src + 8000000 AS src, dst + 8000000 AS dst, event_type AS kind FROM ({NEXT}) JOIN events ON event_id = src WHERE dst IS NOT NULL)"


@frame("g01a_parameter_steps", "SELECT DISTINCT o_orderkey AS src, c_custkey + 3000000 AS dst FROM orders JOIN customer ON c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND c_custkey % 10 = 0 WHERE o_orderkey % 40 = 0 UNION SELECT o_orderkey * 2, o_orderkey FROM orders WHERE o_orderkey % 40 = 0")
def g01a(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders").where("o_orderkey % 40 = 0"), table(spark, sf, "customer")
    parameters = c.where("c_mktsegment = 'BUILDING' and c_custkey % 10 = 0").select((F.col("c_custkey") + 3_000_000).alias("id"), F.lit(1).alias("index"), F.lit("1-URGENT").alias("method"))
    sites = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("callee_signature"), F.array(F.lit(0).cast("long"), F.col("o_orderkey").cast("long")).alias("arguments"), (F.col("o_orderkey") * 2).alias("receiver"))
    none = spark.createDataFrame([], "src long, dst long")
    return A.with_parameter_steps(none, parameters, sites).distinct()


@frame("g01b_field_steps", f"SELECT * FROM {KINDS} WHERE NOT (dst % 2 = 0 AND kind NOT IN ('purchase', 'click'))")
def g01b(spark: SparkSession, sf: str) -> DataFrame:
    named = flow(spark, sf)
    stored = F.when(F.col("kind") == "purchase", "FIELD_STORE").when(F.col("kind") == "click", "ASSIGN").otherwise(F.col("kind"))
    fields = named.where("dst % 2 = 0").select(F.col("dst").alias("id"))
    back = F.when(F.col("kind") == "FIELD_STORE", "purchase").when(F.col("kind") == "ASSIGN", "click").otherwise(F.col("kind"))
    return A.field_steps(named.withColumn("kind", stored), fields).withColumn("kind", back)


PATHS = f"WITH RECURSIVE e AS (SELECT * FROM {KINDS}), w AS (SELECT event_id + 8000000 AS s, event_id + 8000000 AS u, 0 AS d, CAST(event_id + 8000000 AS VARCHAR) AS ids, '' AS kinds FROM events WHERE event_type = 'purchase' AND event_id % 11 = 0 UNION ALL SELECT s, src, d + 1, src || ' -> ' || ids, kind || ',' || kinds FROM w JOIN e ON dst = u WHERE d < 12), found AS (SELECT w.*, event_type FROM w JOIN events ON event_id + 8000000 = u WHERE event_type IN ('signup', 'error'))"


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, _ = Q._next(spark, sf)
    sources = nodes.where("kind in ('signup', 'error')").select("id", F.col("kind").alias("source_type"))
    starts = nodes.where("kind = 'purchase' and (id - 8000000) % 11 = 0")
    return A.propagation_paths(flow(spark, sf), starts, sources, 12), nodes


@frame("g03_propagation_paths", PATHS + " SELECT s AS start, u AS source, event_type AS source_type, d AS depth, ids AS text, kinds FROM found")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    paths, nodes = _paths(spark, sf)
    text = A.described(paths, nodes.select("id", F.col("id").cast("string").alias("description")))
    kinds = F.array_join(F.transform(F.col("steps"), lambda s: F.coalesce(s["kind"], F.lit(""))), ",")
    return text.select("start", "source", "source_type", "depth", "text", kinds.alias("kinds"))


@frame("g04_paths_by_type", PATHS + " SELECT s AS start, event_type AS source_type, count(*) AS paths, max(d) AS max_depth FROM found GROUP BY 1, 2")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return A.paths_by_source_type(_paths(spark, sf)[0])


@frame("g04_all_constants", "SELECT c_custkey AS start, 'IntConstant' AS kind, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_nationkey < 10 UNION SELECT c_custkey, 'EnumConstant', 'Nation.' || n_name || '(' || n_nationkey || ',' || n_regionkey || ')' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey >= 20")
def g04b(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    found = c.select(F.col("c_custkey").alias("start"), F.col("c_nationkey").alias("source"))
    constants = n.where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.lit("IntConstant").alias("kind"), F.col("n_nationkey").cast("string").alias("value"))
    fields = n.where("n_nationkey >= 15").select(F.col("n_nationkey").alias("id"), F.lit("Nation").alias("class"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 20, "Nation").otherwise("String").alias("type"))
    return A.all_constants(found, constants, fields, program(spark, sf).enum_values)


@frame("g05_constants_with_paths", PATHS + " SELECT s AS start, u AS source, 'IntConstant' AS kind, CAST(u AS VARCHAR) AS value, d AS depth, d + 1 AS steps FROM found WHERE event_type = 'signup'")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    paths, nodes = _paths(spark, sf)
    constants = nodes.where("kind = 'signup'").select("id", F.lit("IntConstant").alias("kind"), F.col("id").cast("string").alias("value"))
    return A.constants_with_paths(paths, constants).withColumn("steps", F.size("steps"))


@frame("g06_argument_constants", f"WITH RECURSIVE e AS (SELECT * FROM {KINDS}), w AS (SELECT event_id AS site, event_id + 8000000 AS u, 0 AS d FROM events WHERE event_type = 'error' AND event_id % 5 = 0 UNION ALL SELECT site, src, d + 1 FROM w JOIN e ON dst = u WHERE d < 6) SELECT site AS call_site, 1 AS index, site + 8000000 AS argument, u AS constant, d AS depth FROM w JOIN events ON event_id + 8000000 = u WHERE event_type = 'signup'")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = Q._next(spark, sf)
    sites = nodes.where("kind = 'error' and (id - 8000000) % 5 = 0").select((F.col("id") - 8_000_000).alias("id"), F.array(F.lit(0).cast("long"), F.col("id")).alias("arguments"))
    return A.argument_constants(sites, edges, nodes.where("kind = 'signup'"), (1,), 6)


@frame("g07_actual_types", "SELECT DISTINCT 'm' || c_custkey AS method, n_name AS type FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey >= 10 UNION SELECT 'm' || c_custkey, 'java.lang.Integer' FROM customer WHERE c_nationkey < 10")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """A method returns its nation; where that is opaque, a call of a method that returns a constant is walked into."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    returns = c.select((F.col("c_custkey") + 3_000_000).alias("id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("method"))
    helper = spark.createDataFrame([(1, "helper")], "id int, method string")
    into = c.select((F.col("c_nationkey") + 2_000_000).alias("src"), (F.col("c_custkey") + 3_000_000).alias("dst"))
    typed = n.select((F.col("n_nationkey") + 2_000_000).alias("id"), F.when(F.col("n_nationkey") < 10, "java.lang.Object").otherwise(F.col("n_name")).alias("type"))
    constant = spark.createDataFrame([(2, "IntConstant")], "id int, kind string").select("id", A.boxed(F.col("kind")).alias("type"))
    sites = n.where("n_nationkey < 10").select((F.col("n_nationkey") + 2_000_000).alias("id"), F.lit("helper").alias("callee"), F.lit("java.lang.Object").alias("callee_returns"))
    found = A.actual_types(into.union(spark.createDataFrame([(2, 1)], "src int, dst int")), returns.union(helper), typed.union(constant), sites)
    return found.where("method <> 'helper'")


@frame("g08_fields_of_type", "SELECT p_name AS field, p_brand = 'Brand#11' AS compliant FROM part WHERE p_type = 'STEEL' OR starts_with(p_type, 'PROMO')")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "part").select(F.col("p_name").alias("field"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return A.fields_of_type(fields, ["STEEL", "PROMO*"], F.col("brand") == "Brand#11").select("field", "compliant")


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Segments have a field for each region, set by calls (with suppliers' nations) and stores (of regions' names)."""
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    sites = s.select((F.col("s_suppkey") + 4_000_000).alias("id"), F.concat(F.lit("C"), (F.col("s_suppkey") % 3).cast("string")).alias("callee_class"), F.lit("setHome").alias("callee_name"), F.array((F.col("s_suppkey") + 4_500_000).cast("long")).alias("arguments"))
    dataflow = s.select((F.col("s_nationkey") + 2_000_000).cast("long").alias("src"), (F.col("s_suppkey") + 4_500_000).cast("long").alias("dst")).union(r.select((F.col("r_regionkey") + 1_000_000).cast("long"), (F.col("r_regionkey") + 9_000_000).cast("long")))
    typed = n.select((F.col("n_nationkey") + 2_000_000).alias("id"), F.col("n_name").alias("type"))
    fields = r.select((F.col("r_regionkey") + 9_000_000).alias("id"), F.lit("C0").alias("class"), F.concat(F.lit("area"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("java.lang.Object").alias("type"))
    locals_ = r.select((F.col("r_regionkey") + 1_000_000).alias("id"), F.col("r_name").alias("type"))
    return A.field_assignments(sites, dataflow, typed, fields, locals_), fields


ASSIGNED = "SELECT DISTINCT 'C' || (s_suppkey % 3) AS class, 'home' AS field, n_name AS type FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'C0', 'area' || r_regionkey, r_name FROM region"


@frame("g10_field_assignments", ASSIGNED)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)[0]


@frame("g09_type_structures", f"WITH a AS ({ASSIGNED}) SELECT 'm' AS method, '' AS path, 'C0' AS declared, 'C0' AS actual UNION ALL SELECT 'm', field, 'java.lang.Object', type FROM a WHERE class = 'C0' AND field <> 'home' UNION ALL SELECT 'm', 'home', 'java.lang.Object', type FROM a WHERE class = 'C0' AND field = 'home' UNION ALL SELECT DISTINCT 'm', 'home/back', 'C0', 'C0' FROM a WHERE class = 'C0' AND field = 'home'")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    assigned, fields = _assigned(spark, sf)
    back = table(spark, sf, "nation").select(F.col("n_name").alias("class"), F.lit("back").alias("name"), F.lit("C0").alias("type"))
    declared = fields.select("class", "name", "type").union(spark.createDataFrame([("C0", "home", "java.lang.Object")], "class string, name string, type string")).union(back)
    roots = spark.createDataFrame([("m", "C0")], "method string, type string")
    return A.type_structures(roots, declared, assigned).select("method", F.array_join("path", "/").alias("path"), "declared", "actual").distinct()


@frame("g11_assumptions", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END::BIGINT AS value FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    calls = Q.call_sites(spark, sf)
    return A.assumptions(calls, [(A.method_pattern(cls="1-URGENT"), True), (A.method_pattern(name="F"), 0)])


@frame("g12_comparison", "SELECT p_partkey AS id, op, CASE op WHEN 'EQ' THEN p_size = 25 WHEN 'NE' THEN p_size <> 25 WHEN 'LT' THEN p_size < 25 WHEN 'LE' THEN p_size <= 25 WHEN 'GT' THEN p_size > 25 ELSE p_size >= 25 END AS truth FROM part, (VALUES ('EQ'), ('NE'), ('LT'), ('LE'), ('GT'), ('GE')) v(op)")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.explode(F.array(*map(F.lit, ("EQ", "NE", "LT", "LE", "GT", "GE"))))
    return table(spark, sf, "part").select("p_partkey", "p_size", ops.alias("op")).select(F.col("p_partkey").alias("id"), "op", A.holds(F.col("op"), F.col("p_size") + 0.7, F.lit(25)).alias("truth"))


@frame("g15_unreferenced_fields", "SELECT lower(left(n_name, 1)) || substr(n_name, 2) AS field, 'R' || n_regionkey AS class FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 <> s_nationkey % 5) AND n_nationkey % 4 <> 0")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    name = F.concat(F.lower(F.substring("n_name", 1, 1)), F.substring("n_name", 2, 100))
    owner = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    fields = n.select(name.alias("field"), owner.alias("class"))
    reader = F.concat(F.lit("R"), (F.col("s_suppkey") % 7).cast("string"))
    accesses = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(name.alias("field"), F.when(F.col("s_suppkey") % 7 == F.col("s_nationkey") % 5, owner).otherwise(F.concat(F.lit("X"), reader)).alias("class"))
    calls = n.where("n_nationkey % 4 = 0").select(F.lit("Caller").alias("caller_class"), owner.alias("callee_class"), F.concat(F.lit("get"), "n_name").alias("callee_name"))
    return A.unreferenced_fields(fields, accesses, calls)


@frame("g16_subgraph_edges", "SELECT c_custkey + 3000000 AS src, 2000007 AS dst FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_suppkey + 4000000, 2000007 FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT n_nationkey + 2000000, n_regionkey + 1000000 FROM nation WHERE n_nationkey = 7")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    g = from_tables(spark, sf)
    edges = g.edges["IN_REGION"].frame.union(g.edges["IN_NATION"].frame)
    return subgraph(edges, spark.createDataFrame([(2_000_007,)], "id long"), depth=1)[1]


@frame("g17_endpoints", "SELECT '/' || lower(r_name) || '/' || lower(n_name) AS path, CASE n_nationkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS verb, r_name AS class, n_name AS member FROM nation JOIN region ON r_regionkey = n_regionkey")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 3 == 0, "GetMapping").when(F.col("n_nationkey") % 3 == 1, "PostMapping").otherwise("RequestMapping")
    none = F.lit(None).cast("string")
    inner = both.select(name.alias("name"), F.col("r_name").alias("class"), F.col("n_name").alias("member"), F.array(F.concat(F.lower("n_name"), F.lit("/"))).alias("paths"), none.alias("verb"))
    outer = r.select(F.lit("RequestMapping").alias("name"), F.col("r_name").alias("class"), none.alias("member"), F.array(F.concat(F.lit("//"), F.lower("r_name"))).alias("paths"), none.alias("verb"))
    return A.endpoints(inner.union(outer))


@frame("g18_type_tree", "SELECT 'C0' AS line UNION ALL SELECT '├── a: B | C' UNION ALL SELECT '│   └── x: int' UNION ALL SELECT '└── b: Object → D'")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    text = A.type_tree([([], "C0", "C0"), (["a"], "p.B", "p.B"), (["a"], "p.C", "p.C"), (["a", "x"], "int", "int"), (["b"], "java.lang.Object", "q.D")])
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


# architecture
def classes(c: Column, *more: Column) -> Column:
    return F.concat_ws(".", F.lit("com.acme"), *more, c)


def acme(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' nations call suppliers' nations: package com.acme.r<region>, class N<nation>; parts are classes outside."""
    c, o, n, p = (table(spark, sf, x) for x in ("customer", "orders", "nation", "part"))
    cls = lambda key: F.concat(F.lit("com.acme.r"), (key % 5).cast("string"), F.lit(".N"), key.cast("string"))
    methods = c.select(F.concat(cls(F.col("c_nationkey")), F.lit(".m"), F.col("c_custkey").cast("string")).alias("method"), cls(F.col("c_nationkey")).alias("class"), F.when(F.col("c_custkey") == 1, "main").otherwise("run").alias("name"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    callee = (F.col("o_orderkey") * 7 + F.col("c_nationkey")) % 25
    inner = both.select(cls(F.col("c_nationkey")).alias("caller_class"), cls(callee).alias("callee_class"), F.concat(cls(F.col("c_nationkey")), F.lit(".m"), F.col("c_custkey").cast("string")).alias("caller"))
    outer = both.where("o_orderkey % 4 = 0").select(cls(F.col("c_nationkey")).alias("caller_class"), F.element_at(F.array(*map(F.lit, ("java.util.List", "kotlin.Pair", "org.db.driver.Pool", "org.db.driver.tool.X", "okio.Buffer"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("callee_class"), F.concat(cls(F.col("c_nationkey")), F.lit(".m"), F.col("c_custkey").cast("string")).alias("caller"))
    calls = inner.union(outer).withColumn("callee", F.concat("callee_class", F.lit(".m")))
    endpoints = n.where("n_nationkey % 5 = 2").select(cls(F.col("n_nationkey")).alias("class"))
    return methods, calls, endpoints


INNER = "SELECT 'com.acme.r' || (c_nationkey % 5) AS a, 'com.acme.r' || (((o_orderkey * 7 + c_nationkey) % 25) % 5) AS b FROM orders JOIN customer ON o_custkey = c_custkey"
UNITS = f"WITH i AS ({INNER}), t AS (SELECT unit, count(*) AS traffic FROM (SELECT a AS unit FROM i WHERE a <> b UNION ALL SELECT b FROM i WHERE a <> b) GROUP BY 1), m AS (SELECT 'com.acme.r' || (c_nationkey % 5) AS unit, count(*) AS methods FROM customer GROUP BY 1), u AS (SELECT unit, methods, CASE unit WHEN 'com.acme.r2' THEN 5 ELSE 0 END AS endpoints, traffic FROM m JOIN t USING (unit))"


@frame("k01_boundary", "SELECT 'com.acme' AS boundary")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(K.system_boundary(acme(spark, sf)[0]),)], "boundary string")


@frame("k02_predicates", "SELECT n_name AS nation, 'com.acme.r' || (n_nationkey % 5) AS unit, true AS inside, NULL AS runtime FROM nation UNION ALL SELECT 'outer', 'org.db', false, NULL UNION ALL SELECT 'java', 'java', false, 'java'")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "nation").select(F.col("n_name").alias("nation"), F.concat(F.lit("com.acme.r"), (F.col("n_nationkey") % 5).cast("string"), F.lit(".inner.N")).alias("c"))
    rows = own.union(spark.createDataFrame([("outer", "org.db.driver.Pool"), ("java", "java.util.List")], "nation string, c string"))
    return rows.select("nation", K.package_unit(F.col("c"), "com.acme").alias("unit"), K.is_internal(F.col("c"), "com.acme").alias("inside"), K.runtime_of(F.col("c")).alias("runtime"))


@frame("k04_main_reachability", "WITH mine AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 1), t AS (SELECT 'N' || ((o_orderkey * 7 + c_nationkey) % 25) AS c FROM mine UNION SELECT 'x' || (o_orderkey % 5) FROM mine WHERE o_orderkey % 4 = 0) SELECT 1::BIGINT AS main_methods, 1::BIGINT AS reachable_methods, 1::BIGINT AS reachable_classes, (SELECT count(*) FROM t) AS external_targets")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    methods, calls, _ = acme(spark, sf)
    return K.main_reachability(methods, calls, "com.acme")


@frame("k04_reach_through_calls", f"WITH RECURSIVE e AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL), w AS (SELECT 0 AS u UNION SELECT dst FROM w JOIN e ON src = u) SELECT 1::BIGINT AS main_methods, count(*) AS reachable_methods, count(DISTINCT u % 7) AS reachable_classes, 0::BIGINT AS external_targets FROM w")
def k04b(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = Q._next(spark, sf)
    cls = lambda c: F.concat(F.lit("com.acme.C"), ((c - 8_000_000) % 7).cast("string"))
    first = F.when(F.col("id") == 8_000_000, "main").otherwise("run")
    methods = nodes.select(F.col("id").cast("string").alias("method"), cls(F.col("id")).alias("class"), first.alias("name"))
    calls = edges.select(F.col("src").cast("string").alias("caller"), F.col("dst").cast("string").alias("callee"), cls(F.col("dst")).alias("callee_class"))
    return K.main_reachability(methods, calls, "com.acme")


@frame("k03_subject_role", "SELECT unnest(['booted', 'started', 'serves', 'runs', 'linked']) AS subject, unnest(['application', 'application', 'application', 'application', 'library']) AS role")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    reach = lambda *x: dict(zip(("main_methods", "reachable_methods", "reachable_classes", "external_targets"), x, strict=True))
    rows = [("booted", K.subject_role(reach(1, 2, 2, 9), 0, boot_layout=True, boot_launcher=True, boot_origin=True)), ("started", K.subject_role(reach(1, 1, 1, 9), 0, main_class=True, start_class="a.B")), ("serves", K.subject_role(reach(1, 2, 1, 9), 3)), ("runs", K.subject_role(reach(1, 9, 2, 9), 0)), ("linked", K.subject_role(reach(0, 0, 0, 0), 3))]
    return spark.createDataFrame(rows, "subject string, role string")


OUTER = "SELECT o_orderkey % 5 AS k, count(*) AS w FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1"


def _external(spark: SparkSession, sf: str) -> DataFrame:
    _, calls, _ = acme(spark, sf)
    outside = calls.where(~K.is_internal(F.col("callee_class"), "com.acme"))
    return K.external_dependencies(outside.groupBy(F.col("callee_class").alias("class")).agg(F.count(F.lit(1)).alias("weight")), spark.createDataFrame([("okio.Buffer", "BOOT-INF/lib/okio-core-3.2.jar")], "class string, artifact string"))


@frame("k05_external_dependencies", f"WITH o AS ({OUTER}) SELECT CASE WHEN k = 0 THEN 'runtime:java' WHEN k = 1 THEN 'runtime:kotlin' WHEN k = 4 THEN 'artifact:okio-core-3.2' ELSE 'namespace:org.db.driver' END AS key, CASE WHEN k = 0 THEN 'Java Runtime' WHEN k = 1 THEN 'Kotlin Runtime' WHEN k = 4 THEN 'okio-core-3.2' ELSE 'org.db.driver' END AS name, CAST(sum(w) AS BIGINT) AS weight, CASE WHEN k <= 1 THEN 'runtime' WHEN k = 4 THEN 'artifact' ELSE 'namespace' END AS source, CASE WHEN k <= 1 THEN 'runtime' WHEN k = 4 THEN 'library' ELSE 'external-system' END AS kind, CASE WHEN k IN (2, 3) THEN 'medium' ELSE 'high' END AS confidence FROM o GROUP BY 1, 2, 4, 5, 6")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    return _external(spark, sf)


@frame("k06_library_families", "SELECT CASE WHEN n_regionkey < 3 THEN 'library:lib' || n_regionkey ELSE 'artifact:solo' || n_nationkey || '-' || n_nationkey || '.1' END AS id, CASE WHEN n_regionkey < 3 THEN 'lib' || n_regionkey ELSE 'solo' || n_nationkey || '-' || n_nationkey || '.1' END AS name, CAST(sum(n_nationkey) AS BIGINT) AS weight, CAST(count(*) AS INT) AS members FROM nation GROUP BY 1, 2")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_regionkey") < 3, F.concat(F.lit("lib"), F.col("n_regionkey").cast("string"), F.lit("-n"), key, F.lit("-1.2"))).otherwise(F.concat(F.lit("solo"), key, F.lit("-"), key, F.lit(".1")))
    d = n.select(F.concat(F.lit("artifact:"), name).alias("key"), name.alias("name"), F.col("n_nationkey").cast("long").alias("weight"), F.lit("artifact").alias("source"))
    return K.library_families(d).withColumn("members", F.size("members"))


def _units(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return K.package_units(*acme(spark, sf), "com.acme")


@frame("k07_units", UNITS + " SELECT unit, methods, endpoints::BIGINT AS endpoints, traffic FROM u")
def k07_units(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf)[0]


@frame("k07_layout", UNITS + " SELECT unit, methods + 10 * endpoints + traffic AS score FROM u ORDER BY 2 DESC, traffic DESC, 1 LIMIT 3")
def k07_layout(spark: SparkSession, sf: str) -> DataFrame:
    units, pairs = _units(spark, sf)
    return K.container_layout(units, pairs.limit(0), 3).select("unit", "score")


@frame("k08_clusters", "WITH p AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, CASE WHEN n_nationkey % 3 = 0 THEN 9 ELSE 1 END AS w FROM nation) SELECT 'u' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, 'u' || lpad(CAST(CASE WHEN n_nationkey = 24 THEN 0 WHEN n_nationkey % 3 = 1 THEN n_nationkey - 1 WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE n_nationkey - 2 END AS VARCHAR), 2, '0') AS component FROM nation WHERE n_nationkey < 24")
def k08_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A line of units: 0 and 1, 3 and 4, .. have much traffic, 2, 5, .. little, half of it with the unit before."""
    n = table(spark, sf, "nation").where("n_nationkey < 23")
    name = lambda c: F.concat(F.lit("u"), F.lpad(c.cast("string"), 2, "0"))
    k = F.col("n_nationkey")
    return K.clusters(n.select(name(k).alias("a"), name(k + 1).alias("b"), F.when(k % 3 == 0, 9).otherwise(1).alias("weight")))


@frame("k09_names", UNITS + " SELECT unit AS container, 'R' || right(unit, 1) AS name FROM u")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    units, pairs = _units(spark, sf)
    return K.container_names(K.container_layout(units, pairs.limit(0), 10), units, "com.acme")


@frame("k10_scores_and_kinds", "SELECT n_name AS id, 300 * (n_nationkey % 2) + 200 * (n_regionkey + 2) + 100 * (n_nationkey % 5) + 7::BIGINT AS score, CASE WHEN n_nationkey % 2 > 0 THEN 'entrypoint' WHEN n_nationkey % 5 > greatest(n_regionkey, 2) THEN 'integration' WHEN 2 > n_regionkey THEN 'orchestrator' WHEN n_regionkey > 2 THEN 'shared' ELSE 'coordination' END AS component, CASE WHEN n_nationkey % 2 > 0 THEN 'interface' WHEN n_nationkey % 5 > 0 AND n_nationkey % 5 >= greatest(n_regionkey, 2) THEN 'integration' WHEN 2 > n_regionkey THEN 'orchestrator' WHEN n_regionkey > 2 THEN 'shared' ELSE 'capability' END AS container FROM nation")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    ends, ext, came, went = F.col("n_nationkey") % 2, F.col("n_nationkey") % 5, F.col("n_regionkey"), F.lit(2)
    return n.select(F.col("n_name").alias("id"), K.component_score(ends, came + went, ext, F.lit(3), F.lit(4)).alias("score"), K.component_kind(ends, ext, came, went).alias("component"), K.container_kind(ends, ext, came, went).alias("container"))


@frame("k10_class_scores", "SELECT n_name AS id, CASE WHEN n_nationkey % 3 = 0 AND n_regionkey = 0 THEN (n_nationkey + 9) // 4 ELSE 200 * n_regionkey + n_nationkey + 9 END::BIGINT AS score FROM nation")
def k10b(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    cls = F.concat(F.lit("com.acme.a."), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "Helper").otherwise(""))
    return n.select(F.col("n_name").alias("id"), K.class_score(cls, "com.acme", F.lit(0), F.col("n_regionkey"), F.col("n_nationkey"), F.lit(9), F.lit(3)).alias("score"))


@frame("k10c_dependencies", f"WITH i AS ({INNER}), d AS (SELECT a, b, count(*) AS w FROM i WHERE a <> b GROUP BY 1, 2), k AS (SELECT unnest(['com.acme.r0', 'com.acme.r1', 'com.acme.r2', 'com.acme.r3', 'com.acme.r4']) AS id, unnest(['shared', 'orchestrator', 'interface', 'integration', 'capability']) AS kind, unnest([3, 1, 0, 1, 2]) AS rank), o AS (SELECT CASE WHEN x.rank > y.rank THEN b ELSE a END AS source, CASE WHEN x.rank > y.rank THEN a ELSE b END AS target, w FROM d JOIN k x ON x.id = a JOIN k y ON y.id = b) SELECT source, target, CASE WHEN x.kind = 'interface' THEN 'routes-to' WHEN x.kind = 'orchestrator' THEN 'orchestrates' WHEN y.kind IN ('shared', 'integration') THEN 'uses' ELSE 'collaborates-with' END AS kind, CAST(sum(w) AS BIGINT) AS weight FROM o JOIN k x ON x.id = source JOIN k y ON y.id = target GROUP BY ALL")
def k10c(spark: SparkSession, sf: str) -> DataFrame:
    _, calls, _ = acme(spark, sf)
    units, pairs = _units(spark, sf)
    kinds = spark.createDataFrame([(f"com.acme.r{i}", k) for i, k in enumerate(("shared", "orchestrator", "interface", "integration", "capability"))], "id string, kind string")
    return K.oriented(K.container_dependencies(calls, K.container_layout(units, pairs.limit(0), 10), "com.acme"), kinds)


@frame("k11_readable_edges", "SELECT 'a' || i AS source, 'b' || j AS target FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)) v(i, j)")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    edges = [{"source": f"a{i}", "target": f"b{j}", "kind": "uses", "weight": 100 - 10 * i - j} for i in range(5) for j in range(5)]
    return spark.createDataFrame([(e["source"], e["target"]) for e in K.readable(edges)], "source string, target string")


@frame("k12_reduction", "SELECT 'a' || i AS source, 'a' || (i + 1) AS target FROM range(4) t(i) UNION ALL SELECT 'a0', 'a4'")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    line = [{"source": f"a{i}", "target": f"a{i + 1}", "kind": "uses", "weight": 5} for i in range(4)]
    more = [{"source": "a0", "target": "a4", "kind": "uses", "weight": 6}, {"source": "a0", "target": "a3", "kind": "uses", "weight": 5}, {"source": "a1", "target": "a4", "kind": "runs-on", "weight": 9}]
    return spark.createDataFrame([(e["source"], e["target"]) for e in K.reduced(line + more)], "source string, target string")


@frame("k12_fan_in", f"WITH i AS ({INNER}), d AS (SELECT a AS source, b AS target, count(*) AS weight FROM i WHERE a <> b GROUP BY 1, 2) SELECT source, target, weight FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) <= 2")
def k12b(spark: SparkSession, sf: str) -> DataFrame:
    _, calls, _ = acme(spark, sf)
    units, pairs = _units(spark, sf)
    return K.shared_fan_in(K.container_dependencies(calls, K.container_layout(units, pairs.limit(0), 10), "com.acme"), K.SHARED_DEPENDENCY)


@frame("k13_views", "SELECT unnest(['context', 'container', 'component']) AS level, unnest(['actor', 'first', 'first']) AS shows, true AS some")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    views = K.infer_views(*acme(spark, sf))
    rows = [(v.level, "actor" if v.elements[0]["id"] == "actor" else "first", bool(v.elements)) for v in views.values()]
    return spark.createDataFrame(rows, "level string, shows string, some boolean")


@frame("k14_renderers", "SELECT unnest(['json', 'dsl', 'mermaid', 'plantuml']) AS kind, unnest(['{\"elements\": [{\"id\": \"a\", \"kind\": \"person\", \"name\": \"A\"}, {\"id\": \"b\", \"kind\": \"application\", \"name\": \"B\"}], \"level\": \"context\", \"relationships\": [{\"kind\": \"uses\", \"source\": \"a\", \"target\": \"b\", \"weight\": 1}]}', 'workspace {/  model {/    a = person \"A\" \"person\"/    b = softwareSystem \"B\" \"application\"/    a -> b \"uses\"/  }/}', 'flowchart LR/  a[\"A\"]/  b[\"B\"]/  a -->|uses| b', '@startuml/actor \"A\" as a/rectangle \"B\" as b/a --> b : uses/@enduml']) AS text")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    view = K.View("context", [{"id": "a", "name": "A", "kind": "person"}, {"id": "b", "name": "B", "kind": "application"}], [{"source": "a", "target": "b", "kind": "uses", "weight": 1}])
    return spark.createDataFrame([(k, f(view).replace("\n", "/")) for k, f in (("json", K.to_json), ("dsl", K.to_dsl), ("mermaid", K.to_mermaid), ("plantuml", K.to_plantuml))], "kind string, text string")


# several graphs
@frame("m03_qualified_ids", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS g, count(*) AS n, min(CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END || ':' || (o_orderkey + 6000000)) AS first FROM orders GROUP BY 1")
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return Q._catalog(spark, sf).query("MATCH (o:Order) RETURN o.graphId AS g, count(*) AS n, min(o.qualifiedId) AS first", provenance=False)


@frame("m04_truncated", "WITH r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS graph_id, o_orderkey + 6000000 AS id FROM orders) SELECT graph_id, id, true AS truncated FROM r QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY id) <= 4 AND NOT (graph_id = 'odd' AND row_number() OVER (PARTITION BY graph_id ORDER BY id) = 4)")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    return Q._catalog(spark, sf).fan_out("MATCH (o:Order) RETURN o.id AS id", limit=7)


@frame("m06_versions", "SELECT 2 AS version, (SELECT count(*) FROM nation) AS held, (SELECT count(*) FROM region) AS now")
def m06(spark: SparkSession, sf: str) -> DataFrame:
    c, g = Catalog(spark), from_tables(spark, sf)
    c.register("main", PropertyGraph({"N": g.nodes["Nation"]}, g.edges))
    count = lambda graph, name: query(spark, graph, f"MATCH (n:N) RETURN count(*) AS {name}")
    with c.lease("main") as old:
        c.register("main", PropertyGraph({"N": g.nodes["Region"]}, g.edges))
        held = cut(count(old.graph, "held"))
    return held.crossJoin(count(c.graphs["main"], "now")).select(F.lit(c.versions["main"]).alias("version"), "held", "now")


@frame("m07_listings", f"SELECT 'node' AS kind, CAST(n_nationkey + 2000000 AS VARCHAR) AS id FROM nation WHERE n_nationkey < 5 UNION ALL (SELECT 'method', method FROM ({METHODS}) ORDER BY method LIMIT 5) UNION ALL (SELECT 'call site', CAST(id AS VARCHAR) FROM ({CALLS}) ORDER BY id LIMIT 5) UNION ALL SELECT 'annotation', member FROM (SELECT c_mktsegment, c_name AS member, 'Get' AS a FROM customer WHERE c_nationkey IN (3, 4) UNION ALL SELECT c_mktsegment, c_name, 'Safe' FROM customer WHERE c_nationkey = 3 ORDER BY 1, 2, 3 LIMIT 5)")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    c = registered(spark, sf)
    rows = [("node", c.nodes("main", "nation", 5), "id"), ("method", c.methods("main", limit=5), "method"), ("call site", c.call_sites("main", limit=5), "id"), ("annotation", c.annotations("main", limit=5), "member")]
    out = None
    for kind, df, col in rows:
        one = df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id"))
        out = one if out is None else out.union(one)
    return out


@frame("m08_limits", "SELECT count(*) AS nodes, 50 AS share FROM (SELECT p_partkey FROM part LIMIT 50)")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    c, g = Catalog(spark), from_tables(spark, sf)
    for name in ("a", "b", "c"):
        c.register(name, PropertyGraph({"Part": g.nodes["Part"]}, g.edges))
    return c.listing_all("nodes").agg(F.count(F.lit(1)).alias("nodes")).withColumn("share", F.lit(50))
