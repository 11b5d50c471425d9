"""Program-graph analyses over call sites, dataflow and annotations, each for all starts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.operators.traverse import closure, cut, distances, shortest_paths

MAX_DEPTH = 50


def method_pattern(cls: str | None = None, name: str | None = None, params: list[str] | None = None, returns: str | None = None, prefix: str = "callee_") -> Column:
    """Exact, a prefix with a trailing star, or a full-match regular expression, on each part that is given."""

    def part(column: str, want: str) -> Column:
        c = F.col(prefix + column)
        if want.endswith("*") and not any(x in want[:-1] for x in "^$()[]{}|?+\\*"):
            return c.startswith(want[:-1])
        return (c == want) | c.rlike(f"^(?:{want})$")

    tests = [part(k, v) for k, v in (("class", cls), ("name", name), ("returns", returns)) if v is not None]
    if params is not None:
        tests.append(F.col(prefix + "params") == F.array(*[F.lit(p) for p in params]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def class_overview(call_sites: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """(class, calls) of the top classes, and (source, target, weight) of calls among them."""
    ends = call_sites.select(F.explode(F.array("caller_class", "callee_class")).alias("class"))
    classes = ends.groupBy("class").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "class").limit(top)
    keep = F.broadcast(classes.select("class"))  # at most top rows
    inner = call_sites.join(keep.withColumnRenamed("class", "caller_class"), "caller_class", "left_semi").join(keep.withColumnRenamed("class", "callee_class"), "callee_class", "left_semi")
    return classes, inner.where("caller_class <> callee_class").groupBy(F.col("caller_class").alias("source"), F.col("callee_class").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


def with_parameter_steps(dataflow: DataFrame, parameters: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Dataflow with edges from arguments to the parameters of methods with the same signature, and receivers to call sites."""
    args = call_sites.select("callee_signature", F.posexplode("arguments").alias("index", "src"))
    passed = parameters.join(args, (F.col("method") == F.col("callee_signature")) & (parameters["index"] == args["index"])).select("src", F.col("id").alias("dst"))
    received = call_sites.where("receiver is not null").select(F.col("receiver").alias("src"), F.col("id").alias("dst"))
    return dataflow.select("src", "dst").union(passed).union(received)


def field_steps(dataflow: DataFrame, fields: DataFrame, interprocedural: bool = True) -> DataFrame:
    """Dataflow (src, dst, kind) where, between methods, a field (id) takes values by stores and assignments only."""
    if not interprocedural:
        return dataflow
    into = dataflow.join(fields.select(F.col("id").alias("dst"), F.lit(True).alias("__f")).distinct(), "dst", "left")
    return into.where(F.col("__f").isNull() | F.col("kind").isin("FIELD_STORE", "ASSIGN")).select(*dataflow.columns)


def _back(dataflow: DataFrame) -> DataFrame:
    return dataflow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in dataflow.columns if c not in ("src", "dst")])


def backward_slice(dataflow: DataFrame, starts: DataFrame, sources: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(start, source, depth): sources (id) from which values reach each start (id), with the shortest way's length."""
    back = _back(dataflow.select("src", "dst"))
    return distances(back, starts, depth).join(sources.select(F.col("id").alias("u")).distinct(), "u").select(F.col("s").alias("start"), F.col("u").alias("source"), F.col("dist").alias("depth"))


def forward_slice(dataflow: DataFrame, starts: DataFrame, sinks: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(start, sink, depth)."""
    return distances(dataflow, starts, depth).join(sinks.select(F.col("id").alias("u")).distinct(), "u").select(F.col("s").alias("start"), F.col("u").alias("sink"), F.col("dist").alias("depth"))


def propagation_paths(dataflow: DataFrame, starts: DataFrame, sources: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(start, source, source_type, depth, steps): how the values of sources (id, source_type) reach each start (id).

    steps: an array of (id, kind) from the source to the start; kind is that of the edge that leaves the node, null at the start.
    dataflow: src, dst, kind.  A path stays on the row of its source, so constants and their paths are never out of step.
    """
    tree, _ = shortest_paths(_back(dataflow), starts, depth, F.struct(F.col("dst").alias("id"), "kind"))
    last = F.struct(F.col("s").alias("id"), F.lit(None).cast("string").alias("kind"))
    return tree.join(sources.select(F.col("id").alias("u"), "source_type").distinct(), "u").select(F.col("s").alias("start"), F.col("u").alias("source"), "source_type", F.col("dist").alias("depth"), F.array_append(F.reverse("path"), last).alias("steps"))


def described(paths: DataFrame, descriptions: DataFrame) -> DataFrame:
    """paths with text: the descriptions (id, description) of its nodes, from the source on, joined by arrows."""
    rows = paths.select("start", "source", F.posexplode(F.col("steps.id")).alias("at", "id")).join(descriptions, "id", "left")
    text = rows.groupBy("start", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("description", F.lit("?")).alias("x")))), lambda r: r["x"]), " -> ").alias("text"))
    return paths.join(text, ["start", "source"])


def paths_by_source_type(paths: DataFrame) -> DataFrame:
    """(start, source_type, paths, max_depth)."""
    return paths.groupBy("start", "source_type").agg(F.count(F.lit(1)).alias("paths"), F.max("depth").alias("max_depth"))


def all_constants(found: DataFrame, constants: DataFrame, fields: DataFrame, enum_values: DataFrame) -> DataFrame:
    """(start, kind, value): constants among the sources that were found (start, source), and enum constants that fields stand for.

    constants: id, kind, value.  fields: id, class, name, type; a field of its own class's type is an enum constant.
    """
    direct = found.join(constants.withColumnRenamed("id", "source"), "source").select("start", "kind", "value")
    enums = found.join(fields.where("type = class").withColumnRenamed("id", "source"), "source").join(enum_values.select("class", "name", "args"), ["class", "name"], "left")
    value = F.concat(F.col("class"), F.lit("."), F.col("name"), F.coalesce(F.concat(F.lit("("), F.array_join("args", ","), F.lit(")")), F.lit("")))
    return direct.union(enums.select("start", F.lit("EnumConstant"), value)).distinct()


def constants_with_paths(paths: DataFrame, constants: DataFrame) -> DataFrame:
    """(start, source, kind, value, depth, steps): each constant on one row with its own path."""
    return paths.join(constants.withColumnRenamed("id", "source"), "source").select("start", "source", "kind", "value", "depth", "steps")


def argument_constants(call_sites: DataFrame, dataflow: DataFrame, constants: DataFrame, indices: tuple[int, ...] = (0,), depth: int = MAX_DEPTH) -> DataFrame:
    """(call_site, index, argument, constant, depth) for the arguments at indices."""
    args = call_sites.select(F.col("id").alias("call_site"), F.posexplode("arguments").alias("index", "argument")).where(F.col("index").isin(*indices))
    found = backward_slice(dataflow, args.select(F.col("argument").alias("id")), constants, depth)
    return args.join(found, args.argument == found.start).select("call_site", "index", "argument", F.col("source").alias("constant"), "depth")


#: Types that say nothing about a value, and what constants are boxed to; fixed values.
OPAQUE = ("java.lang.Object", "unknown", "void")
BOXED = {"IntConstant": "java.lang.Integer", "LongConstant": "java.lang.Long", "FloatConstant": "java.lang.Float", "DoubleConstant": "java.lang.Double", "BooleanConstant": "java.lang.Boolean", "StringConstant": "java.lang.String"}


def boxed(kind: Column) -> Column:
    """The type of a constant's label; null for null constants."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in BOXED.items() for x in (k, v)]), kind)


def actual_types(dataflow: DataFrame, returns: DataFrame, typed: DataFrame, call_sites: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(method, type): the types of values that methods return.

    returns: id, method.  typed: id, type; a node of a type that says something ends the walk, others are walked through.  call_sites:
    id, callee, callee_returns: a call of a method that returns an opaque type is walked into, to the method's own returns.
    """
    known = typed.where(F.col("type").isNotNull() & ~F.col("type").isin(*OPAQUE)).distinct()
    back = _back(dataflow.select("src", "dst"))
    if call_sites is not None:
        into = call_sites.where(F.col("callee_returns").isin(*OPAQUE)).select(F.col("id").alias("src"), F.col("callee").alias("method")).join(returns, "method")
        back = back.union(into.select("src", F.col("id").alias("dst")))
    near = distances(back, returns, depth, stop=known)
    return near.where("dist > 0").join(known.withColumnRenamed("id", "u"), "u").join(returns.select(F.col("id").alias("s"), "method"), "s").select("method", "type").distinct()


def fields_of_type(fields: DataFrame, patterns: list[str], compliant: Column | None = None) -> DataFrame:
    """Fields (.., type) whose type is one of patterns, or begins like one with a trailing star; compliant: a test of each, true without one."""
    test = F.lit(False)
    for p in patterns:
        test = test | (F.col("type").startswith(p[:-1]) if p.endswith("*") else F.col("type") == p)
    return fields.where(test).withColumn("compliant", F.lit(True) if compliant is None else F.coalesce(compliant, F.lit(False)))


def field_assignments(call_sites: DataFrame, dataflow: DataFrame, typed: DataFrame, fields: DataFrame, locals_: DataFrame, depth: int = 5) -> DataFrame:
    """(class, field, type): the types that a program assigns to fields anywhere, by setters and by direct stores.

    call_sites: id, callee_class, callee_name, arguments.  typed: id, type.  fields: id, class, name.  locals_: id, type.
    """
    setters = call_sites.where(F.col("callee_name").startswith("set") & (F.length("callee_name") > 3) & (F.size("arguments") == 1))
    field = F.concat(F.lower(F.substring("callee_name", 4, 1)), F.expr("substring(callee_name, 5)"))
    given = setters.select(F.col("callee_class").alias("class"), field.alias("field"), F.col("arguments")[0].alias("id"))
    known = typed.where(F.col("type").isNotNull() & ~F.col("type").isin(*OPAQUE)).distinct()
    near = distances(_back(dataflow.select("src", "dst")), given, depth, stop=known).join(known.withColumnRenamed("id", "u"), "u").select(F.col("s").alias("id"), "type")
    stored = dataflow.select("src", F.col("dst").alias("id")).join(fields.select("id", "class", "name"), "id").join(locals_.where(~F.col("type").isin(*OPAQUE)).select(F.col("id").alias("src"), "type"), "src")
    return given.join(near, "id").select("class", "field", "type").union(stored.select("class", F.col("name").alias("field"), "type")).distinct()


def type_structures(roots: DataFrame, fields: DataFrame, assigned: DataFrame, depth: int = 10) -> DataFrame:
    """(method, path, declared, actual): the structure of returned types, level by level.

    roots: method, type.  fields: class, name, type.  assigned: class, field, type.  A field has the types that are assigned to it, or its
    declared one; a type that is on its own path is not opened again.
    """
    every = fields.select("class", F.col("name").alias("field"), F.col("type").alias("declared")).join(assigned.withColumnRenamed("type", "given"), ["class", "field"], "left")
    every = cut(every.select(F.col("class").alias("of"), "field", "declared", F.coalesce("given", "declared").alias("next")).distinct())
    level = cut(roots.select("method", F.array().cast("array<string>").alias("path"), F.col("type").alias("declared"), F.col("type").alias("actual"), F.array("type").alias("open")).distinct())
    out = level
    for _ in range(depth):
        level = cut(level.join(every, level.actual == every.of).select("method", F.array_append("path", F.col("field")).alias("path"), every.declared, F.col("next").alias("actual"), F.when(~F.array_contains("open", F.col("next")), F.array_append("open", F.col("next"))).alias("open")))
        if level.isEmpty():
            break
        out = out.union(level)
        level = level.where("open is not null")
    return out.select("method", "path", "declared", "actual").distinct()


def type_tree(rows: list[tuple[list[str], str, str]]) -> str:
    """Text of one structure: rows of (path, declared, actual), fields in order below their owner."""
    simple = lambda t: t.rpartition(".")[2]
    tree: dict = {}
    for path, declared, actual in sorted(rows):
        at = tree
        for name in path[:-1]:
            at = at.setdefault(name, ([], {}))[1]
        if path:
            at.setdefault(path[-1], ([], {}))[0].append(simple(declared) if declared == actual else f"{simple(declared)} \u2192 {simple(actual)}")
    out = [" | ".join(sorted({simple(a) for p, _, a in rows if not p}))]

    def add(level: dict, indent: str) -> None:
        names = sorted(level)
        for name in names:
            last = name == names[-1]
            out.append(f"{indent}{'\u2514' if last else '\u251c'}\u2500\u2500 {name}: {' | '.join(level[name][0])}")
            add(level[name][1], indent + ("    " if last else "\u2502   "))

    add(tree, "")
    return "\n".join(out)


def holds(op: Column, left: Column, right: Column) -> Column:
    """A comparison; booleans count 1 and 0, doubles are cut to whole numbers; null only answers EQ and NE."""
    a, b = left.cast("bigint"), right.cast("bigint")
    some = a.isNotNull() & b.isNotNull()
    out = F.when(op == "EQ", left.eqNullSafe(right) if left is right else a.eqNullSafe(b)).when(op == "NE", ~a.eqNullSafe(b))
    for name, test in (("LT", a < b), ("LE", a <= b), ("GT", a > b), ("GE", a >= b)):
        out = out.when((op == name) & some, test)
    return out


def assumptions(call_sites: DataFrame, assumed: list[tuple[Column, object]]) -> DataFrame:
    """(id, value): call sites that a test of an assumption (test, returned value) holds for; the first one that does counts."""
    value = F.lit(None).cast("bigint")
    for test, x in reversed(assumed):
        value = F.when(test, F.lit(x).cast("bigint")).otherwise(value)
    any_ = reduce(lambda a, b: a | b, [t for t, _ in assumed], F.lit(False))
    return call_sites.where(any_).select("id", value.alias("value"))


def dead_branches(assumed: DataFrame, dataflow: DataFrame, scopes: DataFrame, depth: int = MAX_DEPTH, trace_nodes: int | None = None) -> DataFrame:
    """Branches that cannot run if call sites return assumed values.

    assumed: id, value. scopes: condition_id, method, op, comparand, true_ids, false_ids.  trace_nodes: follow each value to its nearest so
    many nodes only (ties by id); all without it.
    Result: condition_id, method, kind (BRANCH_TRUE or BRANCH_FALSE), dead_ids.
    """
    near = distances(dataflow, assumed, depth)
    if trace_nodes is not None:
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("dist", "u"))).where(F.col("n") <= trace_nodes)
    near = near.join(assumed.select(F.col("id").alias("s"), "value"), "s")
    met = scopes.join(near.select(F.col("u").alias("condition_id"), "value").distinct(), "condition_id").withColumn("truth", holds(F.col("op"), F.col("value"), F.col("comparand"))).where("truth is not null")
    return met.select("condition_id", "method", F.when(F.col("truth"), "BRANCH_FALSE").otherwise("BRANCH_TRUE").alias("kind"), F.when(F.col("truth"), F.col("false_ids")).otherwise(F.col("true_ids")).alias("dead_ids")).distinct()


def dead_methods(calls: DataFrame, dead: DataFrame) -> DataFrame:
    """(method): methods all of whose calls are dead, to a fixpoint. calls: id, caller, callee; dead: id of dead calls.

    A method with one live caller shares the caller's fate. So chains of such methods are settled by pointer jumping, and a call from a chain counts
    as one from the chain's head; then methods with several live callers are looked at again, as long as dead ones are found.
    """
    made = lambda name: F.col(name).rlike(r"<(cl)?init>")
    off = dead.select("id").distinct().withColumn("off", F.lit(True))
    how = F.when(F.col("off"), "dead").when(F.col("caller").isNull() | made("caller"), "alive").otherwise("open")
    edges = cut(calls.where(~made("callee")).join(off, "id", "left").select(F.col("callee").alias("method"), F.col("caller").alias("by"), how.alias("how")))
    rounds = []
    while True:
        by = F.when(F.col("how") == "open", F.col("by"))
        low, high = F.min(by), F.max(by)
        stays = F.coalesce(F.bool_or((F.col("how") == "alive") | ((F.col("how") == "open") & (F.col("by") == F.col("method")))), F.lit(False))
        # who is not listed is alive
        state = edges.groupBy("method").agg(F.when(low.isNull(), "dead").when(low == high, "chain").otherwise("multi").alias("kind"), F.when(low == high, low).alias("head"), stays.alias("stays")).where("not stays").drop("stays")
        state = _chain_heads(cut(state))
        gone, several = state.where("kind = 'dead'").select("method"), state.where("kind = 'multi'").select("method")
        if gone.isEmpty():
            break
        rounds.append((gone, state.where("kind = 'tied'").select("method", "head")))
        if several.isEmpty():
            break
        of = state.select(F.col("method").alias("by"), "kind", "head")
        met = edges.where("how = 'open'").join(several, "method", "left_semi").join(of, "by", "left")
        edges = cut(met.select("method", F.coalesce("head", "by").alias("by"), F.when(F.col("kind").isNull(), "alive").when(F.col("kind") == "dead", "dead").otherwise("open").alias("how")).distinct())
    out = calls.select(F.col("callee").alias("method")).limit(0)
    for gone, tied in reversed(rounds):
        out = out.union(gone).union(tied.join(out.withColumnRenamed("method", "head"), "head", "left_semi").select("method"))
    return out


def _chain_heads(state: DataFrame) -> DataFrame:
    """state (method, kind, head) without chains: a method of one is dead, tied to the method with several callers at its head, or left out as alive."""
    settled, chain = state.where("kind <> 'chain'"), state.where("kind = 'chain'")
    length, jumped = chain.count(), 1
    # a chain that is still open after so many steps is a cycle
    while length and jumped <= 2 * length:
        of = settled.union(chain).select(F.col("method").alias("head"), F.col("kind").alias("k"), F.col("head").alias("h"))
        kind = F.when(F.col("k") == "multi", "tied").otherwise(F.col("k"))
        head = F.when(F.col("k") == "multi", F.col("head")).otherwise(F.col("h"))
        new = cut(chain.join(of, "head").select("method", kind.alias("kind"), head.alias("head")).where("head is null or head <> method"))
        settled, chain, jumped = settled.union(new.where("kind <> 'chain'")), new.where("kind = 'chain'"), 2 * jumped
        if chain.isEmpty():
            break
    return settled


def unreferenced_methods(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods that no call names, constructors left out. methods: method; calls: callee."""
    return methods.where(~F.col("method").rlike(r"<(cl)?init>")).join(calls.select(F.col("callee").alias("method")).distinct(), "method", "left_anti")


def accessed_field(name: Column) -> Column:
    """The field that an accessor's name stands for (getX, setX, isX), or null."""
    rest = F.regexp_extract(name, "^(?:get|set|is)(\\p{Lu}.*)$", 1)
    return F.when(rest != "", F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 20)))


def unreferenced_fields(fields: DataFrame, accesses: DataFrame, call_sites: DataFrame | None = None) -> DataFrame:
    """Fields (field, class) that no other class loads or stores (accesses: field, class), or reaches by an accessor.

    call_sites: caller_class, callee_class, callee_name.  Synthetic names are left out.
    """
    outside = accesses.join(fields.withColumnRenamed("class", "owner"), "field").where(F.col("class") != F.col("owner")).select("field", F.col("owner").alias("class"))
    if call_sites is not None:
        outside = outside.union(call_sites.where("caller_class <> callee_class").select(accessed_field(F.col("callee_name")).alias("field"), F.col("callee_class").alias("class")).where("field is not null"))
    return fields.where(~F.col("field").contains("$")).join(outside.distinct(), ["field", "class"], "left_anti")


VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}


def endpoints(annotations: DataFrame) -> DataFrame:
    """(path, verb, class, member) of mapping annotations (name, class, member, paths array, verb), class paths in front."""
    verb = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in VERBS.items() for x in (k, v)]), F.col("name")), F.col("verb"), F.lit("ANY"))
    one = F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("")))
    outer = annotations.where("member is null and name = 'RequestMapping'").select(F.col("class").alias("c"), F.explode(one).alias("base"))
    inner = annotations.where(F.col("member").isNotNull() & F.col("name").isin("RequestMapping", *VERBS)).select("class", "member", verb.alias("verb"), F.explode(one).alias("own"))
    full = F.regexp_replace(F.concat_ws("/", F.lit(""), F.coalesce("base", F.lit("")), F.col("own")), "/+", "/")
    path = F.when(F.length(full) > 1, F.regexp_replace(full, "/$", "")).otherwise(full)
    return inner.join(outer, inner["class"] == outer["c"], "left").select(path.alias("path"), "verb", "class", "member").distinct()


def supertypes(relations: DataFrame, types: DataFrame) -> DataFrame:
    """(s, u, dist): all supertypes of types (id) over relations (src: sub, dst: super)."""
    return closure(relations, types)


def artifact_dependencies(references: DataFrame, origins: DataFrame) -> DataFrame:
    """(source, target, weight) between artifacts. references: from_class, to_class; origins: class, artifact."""
    a, b = origins.select(F.col("class").alias("from_class"), F.col("artifact").alias("source")), origins.select(F.col("class").alias("to_class"), F.col("artifact").alias("target"))
    return references.join(a, "from_class").join(b, "to_class").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
