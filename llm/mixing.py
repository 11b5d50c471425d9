"""Mixing sources to target weights by drawing fixed-length blocks.

1. The words of a source's documents, in an order given by a hash, form one stream, cut into blocks of ``BLOCK`` words.
   Positions come from a two-level prefix sum over (source, bucket), so no task holds a whole source.
2. A source's target in words gives its number of slots.  Output shards hold ``SHARD`` slots each.  The counts of
   sources in a shard are multinomial draws conditioned on the totals, so the totals hit the targets exactly: a binary
   tree over the shards splits the remaining counts hypergeometrically, and a shard only walks its own path.
3. A slot of a source maps to a block by a keyed permutation (Feistel with cycle walking) of the block indexes; the
   slots after one full pass form a second pass.  The last slot takes only the words that are still missing.
4. Slots join blocks by (source, block).

Cases: a null or blank text has size 0 and is never taken.  A null source is a source of its own, last in order.  Repeated
rows are rows of their own.  An empty table, or one without words, has targets of 0.  A text of any length spans as
many blocks as it needs.  Only doc_id, text and source are read; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import fresh, short_batches, staged, table

BLOCK, SHARD, BUCKET_ROWS, WEIGHTS, SHARE, MOST, SEED = 256, 4096, 20_000, (3, 1, 2), 1.5, 2, 20
#: The table of sources (name, size) goes to the driver and to every task; beyond so many the operator refuses.
MOST_SOURCES = 2_000_000

WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(found: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target): share of all words by weight; targets stop at most * size, the excess is reshared."""
    order = sorted(found, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    w = [weights[i % len(weights)] for i in range(len(order))]
    budget = share * sum(n for _, n in order)
    capped: set[int] = set()
    while True:
        free = sum(w[i] for i in range(len(order)) if i not in capped)
        unit = (budget - sum(most * order[i][1] for i in sorted(capped))) / free if free else 0.0
        more = {i for i in range(len(order)) if i not in capped and unit * w[i] > most * order[i][1]}
        if not more:
            return [(s, n, float(most * n) if i in capped else unit * w[i]) for i, (s, n) in enumerate(order)]
        capped |= more


def _round(x: np.ndarray, key: int) -> np.ndarray:
    h = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse, at index; the same for the same key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=7).digest(), "big") for r in range(4)]
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ (_round(left, k) & mask), left) if back else (right, left ^ (_round(right, k) & mask))
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _hypergeometric(rng: np.random.Generator, good: np.ndarray, draws: int) -> np.ndarray:
    """How many of draws come from each kind; beyond numpy's range by the normal approximation, kept feasible."""
    out, rest, left = np.zeros(len(good), np.int64), int(good.sum()), draws
    for i, n in enumerate(good.tolist()):
        others = rest - n
        if rest < 900_000_000:
            k = int(rng.hypergeometric(n, others, left)) if left and rest else 0
        else:
            p = n / rest
            k = round(rng.normal(left * p, (left * p * (1 - p) * (rest - left) / max(1, rest - 1)) ** 0.5))
            k = max(0, left - others, min(n, left, k))
        out[i], rest, left = k, others, left - k
    return out


def shard_counts(slots: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each in it)."""
    lo, hi, before, here = 0, shards, np.zeros(len(slots), np.int64), slots.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _hypergeometric(np.random.default_rng([seed, lo, hi]), here, min((mid - lo) * size, int(here.sum())))
        if shard < mid:
            hi, here = mid, left
        else:
            lo, before, here = mid, before + left, here - left
    return before, here


def slots_of(source: str | None, n_words: int, quota: int, first: int, count: int, block: int, seed: int) -> pd.DataFrame:
    """Slots first..first+count-1 of a source: pass, block, and how many of the block's first words are taken."""
    n = -(-n_words // block)
    j = np.arange(first, first + count)
    turn, at = j // n, j % n
    out, short = np.empty(count, np.int64), n * block - n_words
    length, place = np.full(count, block, np.int64), np.empty(count, np.int64)
    for e in np.unique(turn):
        key, m = f"{seed}/{e}/{source!r}", turn == e
        out[m] = permuted(at[m], n, key)
        where_short = int(permuted(np.array([n - 1]), n, key, back=True)[0])
        place[m] = e * n_words + at[m] * block - np.where(at[m] > where_short, short, 0)
    length[out == n - 1] -= short
    return pd.DataFrame({"turn": turn, "block": out, "words": np.clip(quota - place, 0, length)})


def n_slots(n_words: int, quota: int, block: int, source: str | None, seed: int) -> int:
    """Slots that quota words need; the short block counts by where the permutation puts it."""
    if not quota or not n_words:
        return 0
    n = -(-n_words // block)
    turn, rest = divmod(quota, n_words)
    if not rest:
        return turn * n
    where_short = int(permuted(np.array([n - 1]), n, f"{seed}/{turn}/{source!r}", back=True)[0])
    whole = -(-rest // block)
    return turn * n + (whole if whole <= where_short else -(-(rest + n * block - n_words) // block))


class Mix:
    """rows: doc_id, sid, size, start (first word's place in its source's stream); slots: shard, sid, turn, block, words."""

    def __init__(self, rows: DataFrame, slots: DataFrame, sources: DataFrame, block: int) -> None:
        self.rows, self.slots, self.sources, self.block = rows, slots, sources, block

    def pieces(self) -> DataFrame:
        """Taken ranges: rows' columns, shard, turn, and words [begin, end) of the document."""
        b = F.lit(self.block)
        spread = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        met = spread.join(self.slots, ["sid", "block"])
        begin = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        end = F.least(F.col("block") * b + F.col("words") - F.col("start"), F.col("size"))
        return met.withColumn("begin", begin).withColumn("end", end).where("begin < end")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> Mix:
    spark = docs.sparkSession
    base = staged(sizes(docs), "sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = targets([(r["source"], r["n"]) for r in found], weights, share, most)
    quotas = [min(round(t), int(most * n)) for _, n, t in plan]
    wanted = np.array([n_slots(n, q, block, s, seed) for (s, n, _), q in zip(plan, quotas, strict=True)], np.int64)
    names = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(plan)], "sid int, source string, source_size long, target double")
    by_name = names.select("sid", F.col("source").alias("of"))
    by_name = F.broadcast(by_name) if len(plan) <= 50_000 else by_name

    buckets = max(64, -(-sum(r["rows"] for r in found) // BUCKET_ROWS))
    at = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    placed = base.join(by_name, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "sid", "size", at.alias("at"), F.pmod(at, F.lit(buckets)).alias("bucket"))
    upto = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("sid", "bucket").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["sid", "bucket"]).select("doc_id", "sid", "size", (F.col("offset") + F.col("inside")).alias("start"))

    shards = max(1, -(-int(wanted.sum()) // shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"].tolist():
                before, here = shard_counts(wanted, s, shards, shard, seed)
                for i in np.flatnonzero(here).tolist():
                    part = slots_of(plan[i][0], plan[i][1], quotas[i], int(before[i]), int(here[i]), block, seed)
                    yield part.assign(shard=s, sid=i)[["shard", "sid", "turn", "block", "words"]]

    slots = spark.range(0, shards, 1, min(shards, 2000)).mapInPandas(draw, "shard long, sid int, turn long, block long, words long")
    # written, as Spark takes the output of a small range for small and would broadcast it
    return Mix(staged(rows, "placed"), staged(slots, "slots"), names, block)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    pieces = m.pieces().select("doc_id", "sid", "size", "start", (F.col("end") - F.col("begin")).alias("took"))
    # every row takes part with 0, so that rows of which nothing is taken stay
    every = m.rows.select("doc_id", "sid", "size", "start", F.lit(0).cast("long").alias("took"), F.lit(1).alias("own"))
    per = every.unionByName(pieces.withColumn("own", F.lit(0))).groupBy("doc_id", "sid", "size", "start").agg(F.sum("took").alias("taken"), F.sum("own").alias("times"))
    # blank rows with equal ids share a place: each is given back
    per = per.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return per.join(F.broadcast(m.sources) if m.sources.count() <= 50_000 else m.sources, "sid").select("doc_id", "size", "source_size", "target", "taken")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text: str, size: int, ranges) -> str:
    ranges = sorted((int(r["begin"]), int(r["end"])) for r in ranges)
    joined: list[list[int]] = []
    for a, b in ranges:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    if joined == [[0, size]]:
        return text
    at = [m.span() for m in _WORDS.finditer(text)]
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents: a row for each pass in which words of a document are taken, its text those words.

    Rows that share a doc_id are told apart by source and size; blank documents, and those not drawn, are not in the mix.
    Rows with a null doc_id are mixed like others.
    """
    short_batches(docs.sparkSession)
    m = mix(docs, **kw)
    k, z, s, b = (fresh(docs, x) for x in "kzsb")
    count = lambda df, *by: df.withColumn(k, F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)))
    numbered = count(m.rows.where("size > 0"), "sid", "size").select(F.col("doc_id").alias(z), F.col("sid").alias(s), F.col("start").alias(b), k)
    taken = m.pieces().groupBy("doc_id", "sid", "start", "size", "turn").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    taken = taken.join(numbered, F.col("doc_id").eqNullSafe(F.col(z)) & (F.col("sid") == F.col(s)) & (F.col("start") == F.col(b))).drop(z)
    r, n, words, nth = (fresh(docs, x) for x in ("ranges", "size", "words", "nth"))
    taken = taken.select(F.col("doc_id").alias(z), k, F.col("ranges").alias(r), F.col("size").alias(n))
    whole = count(docs.withColumn(words, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).where(F.col(words) > 0), F.col("source").asc_nulls_last(), words)
    out = whole.withColumnRenamed(k, nth).join(taken, F.col("doc_id").eqNullSafe(F.col(z)) & (F.col(nth) == F.col(k)))

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([_cut(*x) for x in zip(text, size, ranges, strict=True)], dtype=object)

    return out.withColumn("text", cut("text", n, r)).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])
