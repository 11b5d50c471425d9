"""Approximate nearest neighbours by cross-polytope hashing.

1. Each of ``TABLES`` tables turns vectors, scaled to length 1, by fast pseudo-rotations (three rounds of random signs and a Hadamard
   transform) and hashes them to the nearest signed axis of each; the number of axes that make a bucket grows with the table
   (``hashes_for``).  A point is written once, with its bucket in every table.
2. A query probes the buckets whose axes lie nearest to it in each table.  How many, is fitted: ``SAMPLE`` queries are searched whole
   once, and the probes that find ``TARGET`` of their true neighbours in some table, at most ``MOST_PROBES``, are what all queries get.
3. Points stay where they are: they are not copied into tables and not shuffled.  Queries go to them in waves, as one sorted list of
   probed buckets of at most ``PROBED`` entries; a task finds the queries that probe a point's buckets by binary search.  Each pair counts
   once, however many tables give it, and is reranked at once, exactly, by Euclidean distance of the original vectors in double precision.  A
   task only hands on the k + 1 nearest of each query, so a bucket of any size costs no task more than its own points.

Copies of a vector are hashed once and carry their k + 1 smallest ids.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part.  Vectors of another length than the query's
are no candidates.  Rows that repeat id and vector count once.  Fewer than k found: all that were found.  Tables of every size are
hashed and probed; without queries, or in an empty table, the result is empty.  Equal distances go by the smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import short_batches, staged, table
from llm.vectors import distinct_vectors, matrix, queries_of, ranked, usable

TABLES, SEED = 16, 11
#: Vectors in a bucket, on average, from which on buckets are made of one axis more.
FULL = 32
#: Queries that the number of probes is fitted on, share of their neighbours that must be found, most probes in a table.
SAMPLE, TARGET, MOST_PROBES = 64, 0.97, 512
#: Probed buckets of a wave of queries (12 bytes each, beside the queries' vectors), and pairs that are reranked at once.
PROBED, PAIRS = 2_000_000, 16_384


def hashes_for(total: int, dim: int) -> int:
    """Axes that make a bucket: one, and one more whenever buckets of so many would hold more than FULL vectors."""
    axes, n = 2 * (1 << max(0, dim - 1).bit_length()), 1
    while total > FULL * axes**n and n < 4:
        n += 1
    return n


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, which: int, seed: int = SEED) -> np.ndarray:
    """Rows scaled to length 1, padded to a power of two, turned by pseudo-rotation number which."""
    size = np.abs(x).max(1, keepdims=True)
    x = x / size
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng([seed, which, n])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def nearness(x: np.ndarray, table_: int, hashes: int) -> np.ndarray:
    """[row, hash, signed axis]: the component along +axis 0.., then -axis 0.. ."""
    turned = [rotated(x, table_ * hashes + h) for h in range(hashes)]
    return np.stack([np.concatenate([t, -t], 1) for t in turned], 1)


def codes(x: np.ndarray, table_: int, hashes: int) -> np.ndarray:
    near = nearness(x, table_, hashes)
    out = np.zeros(len(x), np.int64)
    for h in range(hashes):
        out = out * near.shape[2] + near[:, h].argmax(1)
    return out


def probes(x: np.ndarray, table_: int, hashes: int, most: int) -> np.ndarray:
    """[row, probe]: the buckets with the largest sums of components."""
    near = nearness(x, table_, hashes)
    axes = near.shape[2]
    most = min(most, axes**hashes)
    code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for h in range(hashes):
        order = np.argsort(-near[:, h], axis=1, kind="stable")[:, :most]
        values = np.take_along_axis(near[:, h], order, 1)
        code = (code[:, :, None] * axes + order[:, None, :]).reshape(len(x), -1)
        total = (total[:, :, None] + values[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :most]
        code, total = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
    return code


def bucket_of(dim: int, table_: int, code: np.ndarray) -> np.ndarray:
    """One number for a table, a length of vectors and a code; should codes pass 40 bits, some buckets share a number."""
    return (np.int64((dim % 4096) * 1024 + table_) << np.int64(40)) + (code & np.int64((1 << 40) - 1))


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dim, part in pdf.groupby("dim"):
        yield int(dim), part, matrix(part["key"], np.float64)


def _least(query: np.ndarray, score: np.ndarray, point: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n smallest scores of each query, ties by the smaller point."""
    order = np.lexsort((point, score, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < n]


def fitted_probes(points: DataFrame, asked: DataFrame, k: int, tables: int, hashes: dict[int, int], sample: int = SAMPLE, target: float = TARGET, most: int = MOST_PROBES) -> int:
    """The probes in each table that find target of the true neighbours of some queries (key, dim; chosen by a hash)."""
    some = asked.orderBy(F.xxhash64("key", F.lit(31)), "key").limit(sample).collect()
    keys = [(r["dim"], np.asarray(r["key"], np.float64)) for r in some]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part, x in _parts(pdf):
                for i, (d, key) in enumerate(keys):
                    if d == dim:
                        score = ((x - key) ** 2).sum(1)
                        # the query's own vector is no neighbour
                        near = [j for j in np.argsort(score, kind="stable")[: k + 1].tolist() if score[j] > 0][:k]
                        yield pd.DataFrame({"i": i, "score": score[near], "key": part["key"].iloc[near].tolist()})

    found = points.select("key", "dim").mapInPandas(nearest, "i int, score double, key array<double>")
    best = found.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "key"))), 1, k).alias("x")).collect()
    ranks = []
    for r in best:
        dim, key = keys[r["i"]]
        near, h = matrix([y["key"] for y in r["x"]], np.float64), hashes[dim]
        first = np.full(len(near), most)
        for t in range(tables):
            asked_ = probes(key[None], t, h, most)[0]
            place = {c: p for p, c in reversed(list(enumerate(asked_.tolist())))}
            first = np.minimum(first, [place.get(c, most) for c in codes(near, t, h).tolist()])
        ranks += first.tolist()
    return min(most, int(np.quantile(ranks, target, method="higher")) + 1) if ranks else 1


class Wave:
    """Queries (number, vector) of one length and the buckets that they probe, sorted."""

    def __init__(self, keys: np.ndarray, tables: int, hashes: int, probed: int) -> None:
        self.keys = keys
        code = np.concatenate([bucket_of(keys.shape[1], t, probes(keys, t, hashes, probed)) for t in range(tables)], 1)
        query = np.repeat(np.arange(len(keys), dtype=np.int32), code.shape[1])
        order = np.argsort(code.ravel(), kind="stable")
        self.bucket, self.query = code.ravel()[order], query[order]

    def pairs(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, query), each once, where one of a point's buckets (a row) is probed by a query."""
        low, high = np.searchsorted(self.bucket, buckets.ravel(), "left"), np.searchsorted(self.bucket, buckets.ravel(), "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.unique(np.repeat(np.arange(len(n)) // buckets.shape[1], n) * len(self.keys) + self.query[at])
        return both // len(self.keys), both % len(self.keys)


def search(vectors: DataFrame, k: int = 10, tables: int = TABLES, hashes: int | None = None, most: int | None = None, wave: int = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score. hashes, most: axes of a bucket and probes in a table, instead of those by size and by fit."""
    spark = vectors.sparkSession
    short_batches(spark, 2048)
    rows = usable(vectors, F.transform("embedding", lambda x: x.cast("double"))).where(F.exists("key", lambda x: x != 0))
    points = staged(distinct_vectors(rows, k + 1).withColumn("dim", F.size("key")), "points")
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = {d: hashes or hashes_for(n, d) for d, n in sizes.items()}
    wanted = queries_of(rows)
    asked = staged(wanted.select("key").distinct().withColumn("dim", F.size("key")), "asked")
    n = asked.count()
    if not n:
        return ranked(wanted, spark.createDataFrame([], "key array<double>, score double, vec_id long"), k, F.col("score").asc())
    probed = most or fitted_probes(points, asked, k, tables, of)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part, x in _parts(pdf):
                yield part.assign(buckets=list(np.stack([bucket_of(dim, t, codes(x, t, of[dim])) for t in range(tables)], 1)))

    placed = staged(points.mapInPandas(hashed, "key array<double>, ids array<long>, dim int, buckets array<long>"), "placed")
    waves, found = max(1, -(-n * tables * probed // wave)), None
    for w in range(waves):
        mine: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(waves)) == w).collect():
            mine.setdefault(r["dim"], []).append(r["key"])
        sent = spark.sparkContext.broadcast({d: Wave(matrix(keys, np.float64), tables, of[d], probed) for d, keys in mine.items()})

        def rerank(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}

            def best(dim: int) -> list:
                q, s, first = (np.concatenate([x[i] for x in held[dim]]) for i in range(3))
                ids = [y for x in held[dim] for y in x[3]]
                keep = _least(q, s, first, k + 1)
                return [q[keep], s[keep], first[keep], [ids[i] for i in keep.tolist()]]

            for pdf in batches:
                for dim, part, x in _parts(pdf):
                    if dim not in sent.value:
                        continue
                    wave_, ids = sent.value[dim], part["ids"].tolist()
                    point, query = wave_.pairs(np.stack(part["buckets"].to_numpy()))
                    score = np.empty(len(point))
                    for i in range(0, len(point), PAIRS):
                        d = x[point[i : i + PAIRS]] - wave_.keys[query[i : i + PAIRS]]
                        # in one plain sum over the components, so that a score does not depend on its neighbours in a batch
                        score[i : i + PAIRS] = np.sqrt((d * d).sum(1))
                    first = np.array([y[0] for y in ids], np.int64)[point]
                    keep = _least(query, score, first, k + 1)
                    held.setdefault(dim, []).append([query[keep], score[keep], first[keep], [ids[i] for i in point[keep].tolist()]])
                    if sum(len(y[0]) for y in held[dim]) > 200_000:
                        held[dim] = [best(dim)]
            for dim in held:
                q, s, _, ids = best(dim)
                yield pd.DataFrame({"key": list(sent.value[dim].keys[q]), "score": s, "ids": ids})

        near = placed.mapInPandas(rerank, "key array<double>, score double, ids array<long>")
        found = near if found is None else found.union(near)
    return ranked(wanted, staged(found, "hits").select("key", "score", F.explode("ids").alias("vec_id")), k, F.col("score").asc())


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
