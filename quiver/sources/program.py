"""Program graphs: side tables of a program, lookups in them, and tables that are derived while a graph is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators.traverse import closure, distances

#: Calls that read resources (class, method, relation), and suffixes of resource formats.
RESOURCE_CALLS = [
    ("java.lang.ClassLoader", "getResource", "OPENS"),
    ("java.lang.ClassLoader", "getResourceAsStream", "OPENS"),
    ("java.lang.ClassLoader", "getResources", "OPENS"),
    ("java.lang.Class", "getResource", "OPENS"),
    ("java.lang.Class", "getResourceAsStream", "OPENS"),
    ("java.util.ResourceBundle", "getBundle", "BUNDLE_CANDIDATE"),
    ("java.util.ResourceBundle", "getString", "LOOKUP"),
    ("java.util.ResourceBundle", "getObject", "LOOKUP"),
    ("java.util.ResourceBundle", "getKeys", "ENUMERATES"),
    ("java.util.Properties", "load", "LOADS"),
    ("java.util.Properties", "getProperty", "LOOKUP"),
    ("java.util.Properties", "stringPropertyNames", "ENUMERATES"),
]
FORMATS = {".properties": "properties", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".xml": "xml"}
#: Bytes of a resource that are read.
RESOURCE_BYTES = 1 << 20


@dataclass
class Program:
    """Tables of a program; those that a program does not have are None.

    methods: method (signature), class, name, params, returns.  call_sites: id, caller, caller_class, caller_name, callee, callee_class,
    callee_name, callee_params, callee_returns, receiver, arguments, line.  type_rel: sub, super, kind.  enum_values: class, name, args.
    annotations: class, member, name, attributes (map).  branch_scopes: condition_id, method, op, comparand, true_ids, false_ids.
    class_origins: class, artifact.
    """

    methods: DataFrame | None = None
    call_sites: DataFrame | None = None
    type_rel: DataFrame | None = None
    enum_values: DataFrame | None = None
    annotations: DataFrame | None = None
    branch_scopes: DataFrame | None = None
    class_origins: DataFrame | None = None

    def find_methods(self, test: Column | None = None, annotated: list[str] | None = None) -> DataFrame:
        """Methods that pass a test (see method_pattern with prefix '') and carry all of the annotations."""
        found = self.methods if test is None else self.methods.where(test)
        if annotated:
            named = self.annotations.where(F.col("name").isin(annotated)).groupBy(F.col("class").alias("__c"), F.col("member").alias("__m")).agg(F.count_distinct("name").alias("__n")).where(F.col("__n") == len(set(annotated)))
            found = found.join(named, (F.col("class") == F.col("__c")) & (F.col("name") == F.col("__m")), "left_semi")
        return found

    def method_slice(self, limit: int, test: Column | None = None) -> DataFrame:
        """The first methods by signature."""
        return self.find_methods(test).orderBy("method").limit(limit)

    def method_count(self, test: Column | None = None) -> DataFrame:
        return self.find_methods(test).agg(F.count(F.lit(1)).alias("methods"))

    def supertypes(self, types: DataFrame, transitive: bool = False) -> DataFrame:
        """(type, super) of types (type): direct ones, or all, however far and cycles or not."""
        return self._related(types, "sub", "super", "super", transitive)

    def subtypes(self, types: DataFrame, transitive: bool = False) -> DataFrame:
        """(type, sub)."""
        return self._related(types, "super", "sub", "sub", transitive)

    def _related(self, types: DataFrame, start: str, end: str, name: str, transitive: bool) -> DataFrame:
        if transitive:
            steps = self.type_rel.select(F.col(start).alias("src"), F.col(end).alias("dst"))
            return closure(steps, types.select(F.col("type").alias("id"))).select(F.col("s").alias("type"), F.col("u").alias(name))
        return types.select("type").distinct().join(self.type_rel.select(F.col(start).alias("type"), F.col(end).alias(name)).distinct(), "type")

    def hierarchy_types(self) -> DataFrame:
        """(type): every type that has a super- or a subtype."""
        return self.type_rel.select(F.explode(F.array("sub", "super")).alias("type")).distinct()

    def enum_arguments(self, wanted: DataFrame) -> DataFrame:
        """wanted (class, name, ..) with args, the constructor's arguments; null for a constant that is not known."""
        return wanted.join(self.enum_values.select("class", "name", "args"), ["class", "name"], "left")

    def member_annotations(self, of: DataFrame | None = None) -> DataFrame:
        """(class, member, annotations): names of annotations with their attributes, for each member, or for those of a table."""
        rows = self.annotations if of is None else self.annotations.join(of.select("class", "member").distinct(), ["class", "member"], "left_semi")
        return rows.groupBy("class", "member").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", F.to_json("attributes"))))).alias("annotations"))

    def scopes_of(self, conditions: DataFrame | None = None) -> DataFrame:
        """Branch scopes, all or those of conditions (id)."""
        return self.branch_scopes if conditions is None else self.branch_scopes.join(conditions.select(F.col("id").alias("condition_id")).distinct(), "condition_id", "left_semi")

    def origin_of(self, classes: DataFrame) -> DataFrame:
        """classes (class, ..) with artifact."""
        return classes.join(self.class_origins, "class", "left")

    def stats(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """One row: nodes, edges, methods, call_sites."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return count(nodes, "nodes").crossJoin(count(edges, "edges")).crossJoin(count(self.methods, "methods")).crossJoin(count(self.call_sites, "call_sites"))


def functional_dispatch(param_calls: DataFrame, passed: DataFrame) -> DataFrame:
    """Call sites that a function handed over as an argument resolves to.

    param_calls: id, method, index and other columns of a call on parameter index of method.  passed: callee, index, target: the functions
    that calls of a method hand over.  Result: the columns of param_calls with callee (the target) and a new id, for each different target.
    """
    targets = passed.select(F.col("callee").alias("method"), "index", "target").distinct()
    found = param_calls.join(targets, ["method", "index"])
    new = F.xxhash64(F.col("id"), F.col("target")).bitwiseOR(F.lit(1 << 62))
    return found.select(new.alias("id"), F.col("id").alias("unresolved_id"), F.col("target").alias("callee"), *[c for c in param_calls.columns if c not in ("id", "callee")])


def returned_targets(returned: DataFrame, results: DataFrame) -> DataFrame:
    """(local, target): functions that a method returns (method, target), for locals that hold a result of it (method, local)."""
    return results.join(returned, "method").select("local", "target").distinct()


def branch_scopes(flow: DataFrame, branches: DataFrame) -> DataFrame:
    """(condition_id, side, id): the nodes that only one side of a branch runs.

    flow: src, dst of control flow.  branches: condition_id, true_start, false_start.  A side runs what its start reaches and the other
    start does not, and its start.
    """
    starts = branches.select(F.explode(F.array("true_start", "false_start")).alias("id")).distinct()
    reach = distances(flow, starts, None).select(F.col("s").alias("start"), F.col("u").alias("id"))
    sides = branches.select("condition_id", F.explode(F.array(F.struct(F.lit("BRANCH_TRUE").alias("side"), F.col("true_start").alias("start"), F.col("false_start").alias("other")), F.struct(F.lit("BRANCH_FALSE").alias("side"), F.col("false_start").alias("start"), F.col("true_start").alias("other")))).alias("b")).select("condition_id", "b.*")
    mine = sides.join(reach, "start")
    theirs = reach.select(F.col("start").alias("other"), "id")
    only = mine.join(theirs, ["other", "id"], "left_anti").select("condition_id", "side", "id")
    return only.union(sides.select("condition_id", "side", F.col("start").alias("id"))).distinct()


def resource_format(path: Column) -> Column:
    out = F.lit("text")
    for suffix, name in FORMATS.items():
        out = F.when(path.endswith(suffix), name).otherwise(out)
    return out


def resource_profile(path: Column) -> Column:
    """The profile in application-<profile>.<ext>, or null."""
    found = F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"^application-([^.]+)\.(?:properties|json|xml|ya?ml)$", 1)
    return F.when(found != "", found)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** crosses folders, * does not."""
    known = {"**/": "(.+/)?", "**": ".*", "*": "[^/]*"}
    out, i = "", 0
    while i < len(glob):
        part = next((k for k in known if glob.startswith(k, i)), glob[i])
        out += known.get(part) or (part if part.isalnum() or part in "_/" else "\\" + part)
        i += len(part)
    return f"^{out}$"


def resources(spark: SparkSession, folder: str, glob: str = "**", most: int = RESOURCE_BYTES) -> DataFrame:
    """(path, source, format, profile, size, content): the files below folder whose path there matches, at most most bytes of each."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split(":", 1)[-1].rstrip("/").lstrip("/")
    path = F.regexp_replace(F.col("path"), f"^[^:/]*:?/*{_quoted(base)}/", "")
    rows = found.select(path.alias("path"), F.lit(folder).alias("source"), F.col("length").alias("size"), F.substring("content", 1, most).alias("content"))
    return rows.where(F.col("path").rlike(glob_pattern(glob))).select("path", "source", resource_format(F.col("path")).alias("format"), resource_profile(F.col("path")).alias("profile"), "size", "content")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)


def resource_links(call_sites: DataFrame, files: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): resource edges from files (id, path) to the call sites that read them.

    call_sites: id, caller_class, callee_class, callee_name, receiver, literal (a first argument that is a string).  A path that a class
    reads is relative to its package unless it begins with a slash.  A bundle is found in its base file and in all of its locales' files.
    bound: local, path, what a local variable was opened from: keys that are read through it are looked up there.
    """
    rules = call_sites.sparkSession.createDataFrame(RESOURCE_CALLS, "callee_class string, callee_name string, kind string")
    calls = call_sites.join(F.broadcast(rules), ["callee_class", "callee_name"])  # a dozen fixed rules
    package = F.regexp_replace(F.regexp_extract("caller_class", r"^(.*)\.[^.]*$", 1), r"\.", "/")
    relative = F.when(F.col("literal").startswith("/"), F.expr("substring(literal, 2)")).when((F.col("callee_class") == "java.lang.Class") & (package != ""), F.concat_ws("/", package, "literal")).otherwise(F.col("literal"))
    files = files.select(F.col("id").alias("src"), "path")
    opened = calls.where("kind = 'OPENS'").select(F.col("id").alias("dst"), "kind", relative.alias("path")).join(files, "path")
    # a bundle's files are joined by their base name, so that locales need no pattern join
    base = files.where(F.col("path").rlike(r"\.(properties|class)$")).withColumn("base", F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), r"(_[a-z]{2,3}(_[A-Z]{2}(_\w+)?)?)$", ""))
    bundle = calls.where("kind = 'BUNDLE_CANDIDATE'").select(F.col("id").alias("dst"), "kind", F.translate("literal", ".", "/").alias("base")).join(base, "base")
    out = opened.select("src", "dst", "kind").union(bundle.select("src", "dst", "kind"))
    if bound is not None:
        read = calls.where("kind in ('LOOKUP', 'ENUMERATES', 'LOADS')").select(F.col("id").alias("dst"), "kind", F.col("receiver").alias("local"))
        out = out.union(read.join(bound, "local").join(files, "path").select("src", "dst", "kind"))
    return out.distinct()
