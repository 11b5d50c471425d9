"""Exact top-k inner products by KD-trees in shards.

1. Vectors are made integers, copies of a vector become one.  Median splits of a bounded sample (``SAMPLE`` vectors) deal all vectors to
   spatial shards; shards that come out too large are cut further by a hash.
2. Each query first searches its home shard, whose k-th score it carries on.  It then goes only to shards whose bounding box
   allows a score of at least that: ties count, as a smaller id may win.
3. In a shard, a KD-tree by median splits on the widest dimension has a tight bounding box at each node.  The search is
   best-first by the bound of box and query, and ends when no bound reaches the k-th score.

Routing gives ids of queries, which meet their vectors only on the way to a shard.  A shard that more than ``VISITORS`` queries go to
is met by so many of them at a time: only its own vectors are copied, once for each such block, so that copies grow with the visits.

Shards number at most ``MOST_SHARDS``, so the boxes that tasks hold are bounded (1 kB each at 64 dimensions).

Cases: vectors that are null, empty, or hold a null or non-finite component take no part.  Vectors of another length than the
query's are no candidates.  Rows that repeat id and vector count once; of an id with several vectors each is a candidate.
Scores beyond 64 bits are cut to the range.  Fewer than k candidates: all.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import short_batches, staged, table
from llm.vectors import distinct_vectors, matrix, queries_of, ranked, usable

SAMPLE, SHARD_ROWS, MOST_SHARDS, LEAF, VISITORS = 20_000, 4096, 16_384, 64, 8192
SAFE = float(1 << 53)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, one row for each of q; beyond 64 bits cut to the range."""
    most = np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0).astype(float) * max(1, x.shape[1])
    if most < SAFE:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest inner product that a vector in a box can have with q, one row for each of q."""
    q, lo, hi = q.astype(float), lo.astype(float), hi.astype(float)
    b = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    # beyond 53 bits the sums are rounded: the bound must not fall short
    return b if np.abs(b).max(initial=0) < SAFE / 4 else b + np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-12


class Tree:
    """Median splits over x; node i has children left[i], right[i] (or rows of a leaf) and a tight box lo[i], hi[i]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.left, self.right, self.rows, lo, hi = x, [], [], [], [], []
        todo = [(np.arange(len(x)), -1, False)]
        while todo:
            rows, parent, is_right = todo.pop()
            i = len(self.left)
            part = x[rows]
            lo.append(part.min(0)), hi.append(part.max(0))
            self.left.append(-1), self.right.append(-1), self.rows.append(None)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = i
            wide = (hi[-1].astype(float) - lo[-1].astype(float)).argmax()
            if len(rows) <= leaf or hi[-1][wide] == lo[-1][wide]:
                self.rows[i] = rows
                continue
            order, half = np.argsort(part[:, wide], kind="stable"), len(rows) // 2
            todo += [(rows[order[half:]], i, True), (rows[order[:half]], i, False)]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def search(self, q: np.ndarray, limit: np.ndarray, ids: list, k: int) -> list[list[tuple[int, int]]]:
        """For each row of q its k best (score, -id) of at least limit, best first."""
        allowed, out = bounds(q, self.lo, self.hi), []
        for a, one, least in zip(allowed, q, limit.tolist(), strict=True):
            best: list[tuple[int, int]] = []
            queue = [(-a[0], 0)]
            while queue:
                b, i = heapq.heappop(queue)
                if -b < least or len(best) == k and -b < best[0][0]:
                    break
                if self.rows[i] is None:
                    for c in (self.left[i], self.right[i]):
                        heapq.heappush(queue, (-a[c], c))
                    continue
                scores = products(one[None], self.x[self.rows[i]])[0]
                floor = max(least, best[0][0]) if len(best) == k else least
                for r in np.flatnonzero(scores >= floor).tolist():
                    for v in ids[self.rows[i][r]]:
                        if len(best) < k:
                            heapq.heappush(best, (int(scores[r]), -int(v)))
                        elif (int(scores[r]), -int(v)) > best[0]:
                            heapq.heapreplace(best, (int(scores[r]), -int(v)))
                        else:
                            break
            out.append(sorted(best, reverse=True))
        return out


def shard_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Median splits in heap order: (dimension, value); vectors below the value go left."""
    out, level = [], [sample]
    for _ in range(depth):
        following = []
        for x in level:
            if len(x):
                d = int((x.max(0).astype(float) - x.min(0).astype(float)).argmax())
                cut = int(np.sort(x[:, d])[len(x) // 2])
                out.append((d, cut))
                following += [x[x[:, d] < cut], x[x[:, d] >= cut]]
            else:
                out.append((0, 0))
                following += [x, x]
        level = following
    return out


def deal(x: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """The shard of each row of x."""
    if not splits:
        return np.zeros(len(x), np.int64)
    dim, cut = (np.array(c) for c in zip(*splits, strict=True))
    node = np.zeros(len(x), np.int64)
    while node[0] < len(splits):
        node = 2 * node + 1 + (x[np.arange(len(x)), dim[node]] >= cut[node])
    return node - len(splits)


def quantised():
    return F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))


def top_k(vectors: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (long)."""
    spark = vectors.sparkSession
    short_batches(spark, 2048)
    rows = usable(vectors, quantised())
    # one more than k, as a query's own id may be among them
    points = staged(distinct_vectors(rows, k + 1).withColumn("dim", F.size("key")), "points")
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = sum(sizes.values())
    at = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn: dict[int, list] = {}
    for r in points.where(at < min(1.0, sample / total)).select("dim", "key").collect():
        drawn.setdefault(r["dim"], []).append(r["key"])
    size = max(shard_rows, -(-total // MOST_SHARDS))
    splits = {d: shard_tree(matrix(drawn[d]), max(0, (-(-n // size) - 1).bit_length())) if d in drawn else [] for d, n in sizes.items()}

    @F.pandas_udf("long")
    def shard(keys: pd.Series, dims: pd.Series) -> pd.Series:
        out = np.empty(len(keys), np.int64)
        for d in dims.unique().tolist():
            m = (dims == d).to_numpy()
            out[m] = deal(matrix(keys[m]), splits[d]) * 65_536 + d
        return pd.Series(out)

    placed = points.withColumn("shard", shard("key", "dim"))
    placed = staged(placed, "placed")
    # shards that the sample left too large are cut by a hash; a query's home is the first part
    over = {r["shard"]: -(-r["n"] // (2 * size)) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * size).collect()}
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, n in over.items() for x in (s, n)]), F.col("shard")), F.lit(1)) if over else F.lit(1)
    cut = placed.select("dim", "key", "ids", F.concat_ws("/", "shard", F.pmod(F.xxhash64("key"), parts)).alias("sid"))
    wanted = queries_of(rows)
    asked = staged(wanted.select("key").distinct().withColumn("dim", F.size("key")).withColumn("home", F.concat_ws("/", shard("key", "dim"), F.lit(0))).withColumn("query", F.xxhash64("key")), "asked")

    best = "key array<long>, score long, vec_id long"

    def search(_, points_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if not len(points_) or not len(asked_):
            return pd.DataFrame(columns=["key", "score", "vec_id"], dtype=object)
        tree = Tree(matrix(points_["key"]))
        found = tree.search(matrix(asked_["key"]), asked_["least"].to_numpy(np.float64), points_["ids"].tolist(), k + 1)
        out = [(key, s, -v) for key, one in zip(asked_["key"], found, strict=True) for s, v in one]
        return pd.DataFrame(out, columns=["key", "score", "vec_id"])

    def met(visits: DataFrame) -> DataFrame:
        """The results of queries in shards. visits: query, least, sid."""
        many = visits.groupBy("sid").agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITORS)).cast("int").alias("blocks"))
        spread = cut.join(many, "sid").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        block = F.pmod(F.xxhash64("query", F.lit(9)), F.col("blocks")).cast("int").alias("block")
        sent = visits.join(many, "sid").join(asked.select("query", "key"), "query").select("key", F.col("least").cast("double").alias("least"), "sid", block)
        return spread.groupBy("sid", "block").cogroup(sent.groupBy("sid", "block")).applyInPandas(search, best)

    home = staged(met(asked.select("query", F.lit(float("-inf")).alias("least"), F.col("home").alias("sid"))), "home")
    # a k-th score is propagated only where the home shard had k + 1 results
    kth = home.groupBy("key").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).select("key", F.when(F.col("n") > k, F.col("s").cast("double")).otherwise(F.lit(float("-inf"))).alias("least"))
    boxes = _boxes(cut)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, part in pdf.groupby("dim"):
                sids, lo, hi = boxes[d]
                keys, least = matrix(part["key"]), part["least"].to_numpy()
                for i, row in enumerate(bounds(keys, lo, hi) >= least[:, None]):
                    out += [(part["query"].iloc[i], least[i], sids[j]) for j in np.flatnonzero(row).tolist() if sids[j] != part["home"].iloc[i]]
            yield pd.DataFrame(out, columns=["query", "least", "sid"])

    further = asked.join(kth, "key", "left").select("query", "key", "dim", "home", F.coalesce("least", F.lit(float("-inf"))).alias("least")).mapInPandas(route, "query long, least double, sid string")
    found = home.unionByName(met(staged(further, "visits")))
    return ranked(wanted, found, k, F.col("score").desc())


def _boxes(cut: DataFrame) -> dict[int, tuple[list[str], np.ndarray, np.ndarray]]:
    """dim -> (shard ids, lower corners, upper corners), exact over all vectors; shards are at most MOST_SHARDS and their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["dim", "sid"]):
                x = matrix(part["key"])
                lo, hi = x.min(0), x.max(0)
                old = held.get(key)
                held[key] = [lo, hi] if old is None else [np.minimum(old[0], lo), np.maximum(old[1], hi)]
        yield pd.DataFrame([(d, s, lo, hi) for (d, s), (lo, hi) in held.items()], columns=["dim", "sid", "lo", "hi"])

    shape = "dim int, sid string, lo array<long>, hi array<long>"
    merged = cut.select("dim", "sid", "key").mapInPandas(run, shape).groupBy("sid").applyInPandas(lambda p: pd.DataFrame({"dim": p["dim"].iloc[:1], "sid": p["sid"].iloc[:1], "lo": [matrix(p["lo"]).min(0)], "hi": [matrix(p["hi"]).max(0)]}), shape)
    out: dict[int, tuple[list, list, list]] = {}
    for r in merged.collect():
        s, lo, hi = out.setdefault(r["dim"], ([], [], []))
        s.append(r["sid"]), lo.append(r["lo"]), hi.append(r["hi"])
    return {d: (s, matrix(lo), matrix(hi)) for d, (s, lo, hi) in out.items()}


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
