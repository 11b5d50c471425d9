"""Secret scanning: candidates by patterns, false positives removed by a random forest.  DataFrame functions only.

A candidate is a run of 16 or more token characters with a digit in it (an equals sign only ends one, so that a name it is assigned to stays outside), a quoted value assigned to a word such as
``password``, or a PEM private key.  The forest looks at its length, character classes and their transitions, coverage by
dictionary words, path context, and neighbouring words.  It is trained on labelled findings, ``labelled_findings``, made
by rule: ``TRAIN`` rows, a documented bound.  The fitted trees become one constant, an array of node arrays, which a Column
expression walks, so scoring stays inside the projection that scans the text: no shuffle, no Python on executors.

Cases: a null or empty text has no candidates.  Repeated rows are scanned each on its own.  Texts of any length are
scanned whole, and candidates of any length are taken whole.  Overlapping matches cannot occur: the leftmost one is taken and scanning goes on behind it.  Extra
columns are ignored by ``findings`` and kept by ``redacted``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import fresh, staged, table

TRAIN, TREES, DEPTH, THRESHOLD = 4000, 15, 6, 0.5
MARK = "[SECRET]"

RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+"
ASSIGNED = r"(?<=[\"'])(?<=(?i:passwo?r?d|pwd|secret|token|api.?key)[\"']?\s{0,2}[:=]\s{0,2}[\"'])[^\"'\s]{8,}+(?=[\"'])"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
CANDIDATE = f"(?:{PEM}|{ASSIGNED}|{RUN})"
#: What stands before a candidate, the candidate, what follows; at last the rest of the text, with an empty candidate.
FOUND = rf"([\s\S]*?)(?:({CANDIDATE})(?=([\s\S]{{0,24}}))|\z)"

#: Fixed word lists: what a dictionary of identifiers covers; what stands before a secret; before something harmless.
WORDS = "access account admin alpha and api app auth backup base beta build cache change class client code commit config content count data date debug default demo dev document domain dummy email empty enter error example false field file final first folder for from group hash here home host html http https image index info insert item key label last link list local login main master menu model module name new node none not null number object option order output page param pass password path place placeholder port private prod product project public query readme release remote replace report request reset result role root sample schema script secret section server service session setting source stage start state static status string style system table tag temp template test text the this time title token true type update upload url user value version view web with word xxxx your".split()
BEFORE_SECRET = r"(?i)(passwo?r?d|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer)[\w.-]{0,20}[\"']?\s*(?:[:=]|=>|:=)?\s*[\"']?$"
BEFORE_OTHER = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|integrity|etag|uuid|guid|revision|build|version|order|invoice|isbn|serial|phone|image|session.?id|trace.?id|request.?id)[\w.-]{0,12}[\"']?\s*[:=]?\s*[\"']?$"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|AIza|sk[-_]|pk[-_]|eyJ|-----BEGIN)"

FEATURES = ("size", "digits", "upper", "hex", "transitions", "distinct", "words", "in_path", "slashes", "before_secret", "before_other", "assigned", "quoted", "prefix", "dashes")


def features(value: Column, before: Column, after: Column) -> Column:
    """An array of doubles, in the order of FEATURES."""
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]", "")) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    classes = value
    for keep, mark in (("a-z", "a"), ("A-Z", "A"), ("0-9", "0")):
        classes = F.regexp_replace(classes, f"[{keep}]+", mark)
    rest = F.regexp_replace(F.lower(value), "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), "")
    made = {
        "size": F.least(F.length(value), F.lit(512)),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "transitions": (F.length(classes) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(n, F.lit(64)),
        "words": 1.0 - F.length(rest) / n,
        "in_path": flag(before.rlike(r"(://\S*|[\w-]/|[.\\/])$") | after.rlike(r"^(\.[a-z]{2,4}\b|/)")),
        "slashes": F.length(F.regexp_replace(value, "[^/]", "")),
        "before_secret": flag(before.rlike(BEFORE_SECRET)),
        "before_other": flag(before.rlike(BEFORE_OTHER)),
        "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "prefix": flag(value.rlike(PREFIX)),
        "dashes": share("_-"),
    }
    return F.array(*[made[f].cast("double") for f in FEATURES])


def labelled_findings(spark: SparkSession, n: int = TRAIN) -> DataFrame:
    """Labelled findings (value, before, after, label), made by rule from row numbers: kinds that are secrets, kinds that are not."""
    i = F.col("id")
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 512)
    rnd = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), rnd(salt, len(xs)) + 1)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), "[\\n\\r=]", "")
    cut = lambda c, lo, hi, salt: F.substring(c, F.lit(1), F.lit(lo) + rnd(salt, hi - lo + 1))
    prose = lambda salt: F.concat(pick(salt, ["the ", "and then ", "of ", "le ", "der und ", "que la ", ". ", ", "]), pick(salt + "2", ["", "in ", "with ", "is "]))
    key = pick("key", ["token", "api_key", "secret", "password", "aws_secret_access_key", "auth_token", "API-KEY", "client_secret", "passwd", "access_key"])
    sign = pick("sign", [" = ", "=", ": ", " := ", ":"])
    quote = pick("quote", ['"', "'", '"', ""])
    plain = pick("plain", ["id", "ref", "name", "item", "see", "no", "file", "page", "key", "value"])
    other = pick("other", ["commit ", "sha256:", "md5 = ", "checksum: ", "integrity=", "etag: ", "build ", "digest ", "revision "])
    sep = pick("sep", ["_", "-", ""])
    words = F.concat(pick("w1", WORDS), sep, pick("w2", WORDS), sep, pick("w3", WORDS), sep, pick("w4", WORDS), sep, F.lpad(rnd("w5", 1000).cast("string"), 2, "0"))
    size = pick("size", [32, 40, 64])
    hexed = F.substring(hexes("a"), F.lit(1), size)
    uuid = F.regexp_replace(F.substring(hexes("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    known = F.concat(pick("pre", ["AKIA", "ghp_", "xoxb-", "AIza", "sk_", "eyJ", "glpat-"]), cut(b64("k"), 16, 40, "kl"))
    kinds = [
        (1, hexed, F.concat(prose("p"), key, sign, quote), quote),
        (1, cut(b64("b"), 20, 44, "bl"), F.concat(prose("p"), key, sign, quote), quote),
        (1, known, F.concat(prose("p"), plain, pick("s2", [" ", " = ", ": "]), quote), quote),
        (1, F.concat(pick("w1", WORDS), cut(b64("m"), 8, 14, "ml")), F.concat(prose("p"), pick("pw", ["password", "passwd", "pwd", "secret"]), sign, F.lit('"')), F.lit('"')),
        (1, hexed, F.concat(prose("p"), key, F.lit(" "), quote), quote),
        (0, hexed, F.concat(prose("p"), other, quote), quote),
        (0, uuid, F.concat(prose("p"), plain, sign, quote), quote),
        (0, words, F.concat(prose("p"), plain, sign, quote), quote),
        (0, words, F.concat(prose("p"), key, sign, quote), quote),
        (0, cut(b64("h"), 16, 60, "hl"), F.concat(F.lit("https://example.com/"), plain, F.lit("/")), F.lit(".html")),
        (0, F.concat_ws("/", pick("w1", WORDS), pick("w2", WORDS), pick("w3", WORDS), rnd("d", 10000).cast("string")), prose("p"), F.lit(".png")),
        (0, F.lpad(F.abs(F.xxhash64(i, F.lit("n"))).cast("string"), 16, "4"), prose("p"), F.lit(" ")),
        (0, F.concat(F.repeat(pick("x", ["x", "0", "ab", "12"]), 10), F.lit("00000001")), F.concat(prose("p"), key, sign, quote), quote),
        (0, F.concat_ws("-", rnd("y", 2030).cast("string"), F.lit("12"), F.lit("01T10"), pick("w1", WORDS)), F.concat(prose("p"), plain, F.lit(" ")), F.lit(" ")),
        (0, hexed, F.concat(prose("p"), plain, F.lit("/")), F.lit("/")),
    ]
    which = rnd("kind", len(kinds))
    choose = lambda k: F.coalesce(*[F.when(which == j, x[k]) for j, x in enumerate(kinds)])
    return spark.range(0, n, 1, 4).select(choose(1).alias("value"), choose(2).alias("before"), choose(3).alias("after"), F.coalesce(*[F.when(which == j, F.lit(float(x[0]))) for j, x in enumerate(kinds)]).alias("label"))


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list:
    """The forest: for each tree, arrays by node of feature, threshold, left and right child (a leaf's are itself), share of secrets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = (labelled_findings(spark) if findings is None else findings).select("label", features(F.col("value"), F.col("before"), F.col("after")).alias("f"))
    rows = staged(rows.select("label", *[F.col("f")[i].alias(name) for i, name in enumerate(FEATURES)]), "training")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxBins=64).fit(data)

    def grown(root) -> dict:
        tree: dict = {"feature": [], "limit": [], "left": [], "right": [], "value": []}

        def add(node) -> int:
            i = len(tree["value"])
            leaf = node.getClass().getSimpleName() == "LeafNode"
            stats = list(node.impurityStats().stats())
            for name, x in (("feature", 0 if leaf else node.split().featureIndex()), ("limit", 0.0 if leaf else node.split().threshold()), ("left", i), ("right", i), ("value", stats[1] / sum(stats))):
                tree[name].append(x)
            if not leaf:
                tree["left"][i], tree["right"][i] = add(node.leftChild()), add(node.rightChild())
            return i

        add(root)
        return tree

    return [grown(t.rootNode()) for t in model._java_obj.trees()]


_TREE = "array<struct<feature:array<int>,limit:array<double>,left:array<int>,right:array<int>,value:array<double>>>"


def score(forest: list, f: Column, depth: int = DEPTH) -> Column:
    """The mean share of secrets over the leaves that f falls into."""
    trees = F.from_json(F.lit(json.dumps(forest)), _TREE)

    def leaf(t: Column) -> Column:
        step = lambda i, _: F.when(F.get(f, F.get(t["feature"], i)) <= F.get(t["limit"], i), F.get(t["left"], i)).otherwise(F.get(t["right"], i))
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)

    return F.aggregate(trees, F.lit(0.0), lambda total, t: total + F.get(t["value"], leaf(t))) / float(len(forest))


def scanned(docs: DataFrame, forest: list, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of (gap, value, score), and its name: candidates and, with an empty value, the rest of the text."""
    text, c = F.col(text_col), fresh(docs, "found")
    part = lambda k: F.regexp_extract_all(text, F.lit(FOUND), F.lit(k))
    raw = F.arrays_zip(part(1).alias("gap"), part(2).alias("value"), part(3).alias("after"))
    # most texts hold no candidate: those are told by one cheap scan
    has = text.rlike(CANDIDATE)
    empty = F.array().cast("array<struct<gap:string,value:string,after:string>>")
    described = F.transform(F.when(has, raw).otherwise(empty), lambda x: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), features(x["value"], F.substring(F.concat(F.lit(" " * 48), x["gap"]), -48, 48), x["after"]).alias("f")))
    return docs.withColumn(c, F.transform(described, lambda x: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), score(forest, x["f"]).alias("score")))), c


def findings(docs: DataFrame, forest: list, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start (code points from 0), n_chars, value, score, is_secret, for each candidate."""
    out, c = scanned(docs.select("doc_id", "text"), forest)
    # the number is given before candidates are spread out, so that those of one row share it
    rows = out.where(F.size(c) > 0).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode(c).alias("k", "x")).select("doc_id", "row", "k", "x.*").where("value <> ''")
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("gap") + F.length("value")).over(upto) - F.length("value")
    return rows.select("doc_id", start.cast("long").alias("start"), F.length("value").cast("long").alias("n_chars"), "value", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), train(spark))


def _secret(x: Column, threshold: float) -> Column:
    return (x["value"] != "") & (x["score"] >= threshold)


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets in text replaced by MARK, and n_chars to match; every document stays, one without a secret as it is, null texts too."""
    out, c = scanned(docs, train(docs.sparkSession))
    kept = F.array_join(F.transform(c, lambda x: F.concat(x["gap"], F.when(_secret(x, threshold), F.lit(MARK)).otherwise(x["value"]))), "")
    text = F.when(F.exists(c, lambda x: _secret(x, threshold)), kept).otherwise(F.col("text"))
    new, had = fresh(out, "text"), docs.columns
    out = out.withColumn(new, text)
    swap = {"text": F.col(new).alias("text"), "n_chars": F.when(F.col(new).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new)).cast("long").alias("n_chars")}
    return out.select(*[swap.get(x, F.col(f"`{x}`")) for x in had])
