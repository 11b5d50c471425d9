"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

1. A bounded sample of labelled rows (about ``EXAMPLES`` of each label) gives the examples.  All their terms are indexed; a term is a
   word's first ``STEM`` letters, so that inflected and compound words share it.
2. Document frequencies of these terms are counted over all documents, for IDF.
3. A component of a text's vector is (1 + ln tf) * idf * relevance.  The relevance of a term is the log-likelihood ratio of its document
   frequencies under the two labels of the examples: it weighs terms by how much they tell the labels apart, and leaves none out.
4. The examples' unit vectors fill an inverted index.  The postings of a term are cut into blocks of ``BLOCK`` examples, each with
   its largest weight.  A text's terms bound the cosines of every block from above; blocks are scored in the order of their bounds
   until no bound reaches the k-th cosine.  The result is the exact k nearest.
5. Neighbours vote with weight 1 / (distance + 0.1); votes are corrected for the balance of the sample, and a table
   fitted by isotonic regression on the examples (each scored without itself) turns them into probabilities.  ``evidence``
   lists the neighbours' doc_ids and cosines.

Equal cosines tie; the example with the smaller doc_id comes first.  A text that shares no term with any example is at
distance 1 from all, and gets the calibrated share of label 1 among such examples.

Cases: null and empty texts are scored like texts without terms.  With no labelled rows of one kind no term is relevant, and the
score is the share of label 1 (0 without any).  Repeated rows are scored each on its own; of a labelled doc_id with several texts the
least is the example, and its label is 1 if one of its labels is.  Whole texts of any length are counted.  Empty tables give empty results.
Extra columns are ignored.  A null doc_id is never learned from and never held out.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import held_out, short_batches, table

#: Labelled rows of each label that are learned from (about; chosen by a hash of doc_id), examples in a block, neighbours.
EXAMPLES, BLOCK, NEIGHBOURS = 1500, 128, 15
#: Letters of a word that make its term, and the score from which on a text is predicted to be toxic.
STEM, CUT = 6, 0.3

_TERM = re.compile(rf"([^\W\d_]{{1,{STEM}}})[^\W\d_]*")


def terms(text: str | None) -> list[str]:
    """The terms of a text, as often as they occur."""
    return _TERM.findall(text.lower()) if text else []


def relevance(with_one: np.ndarray, with_zero: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """The log-likelihood ratio of each term's document frequencies under the two labels; 0 where a label has no example."""
    if not ones or not zeros:
        return np.zeros(len(with_one))
    share, out = (with_one + with_zero) / (ones + zeros), np.zeros(len(with_one))
    for seen, total in ((with_one, ones), (with_zero, zeros)):
        for got, p in ((seen, share), (total - seen, 1 - share)):
            fine = (got > 0) & (p > 0)
            out[fine] += 2 * got[fine] * np.log(got[fine] / (total * p[fine]))
    return np.maximum(out, 0.0)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] numbers), start[1], .."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index:
    """The examples' unit TF-IDF vectors as postings in blocks; plain arrays travel, the rest is made where it is used."""

    def __init__(self, terms: list[str], weight: np.ndarray, ids: list[int], labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.terms, self.weight, self.counts = terms, weight, counts
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int8)
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.prior = 0.5
        self._open()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("terms", "weight", "counts", "ids", "labels", "table", "prior")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        self.ones = self.labels.tolist()
        self.column, n = {t: i for i, t in enumerate(self.terms)}, len(self.terms)
        held = [self.unit(c, k) for c, k in self.counts]
        # examples with the same heaviest terms go into one block: its bounds are the tighter
        heavy = [tuple(c[np.argsort(-w, kind="stable")[:3]].tolist()) for c, w in held]
        self.place = np.array(sorted(range(len(held)), key=heavy.__getitem__), np.int64)
        held = [held[i] for i in self.place.tolist()]
        col = np.concatenate([c for c, _ in held]) if held else np.empty(0, np.int64)
        value = np.concatenate([w for _, w in held]) if held else np.empty(0)
        example = np.repeat(np.arange(len(held)), [len(c) for c, _ in held]) if held else np.empty(0, np.int64)
        order = np.lexsort((example, col))
        col, self.example, self.value = col[order], example[order].astype(np.int32), value[order]
        # a block entry is a term and a block of examples: where its postings start, how many they are, the largest weight
        block = self.example // BLOCK
        first = np.flatnonzero(np.append(True, (col[1:] != col[:-1]) | (block[1:] != block[:-1]))) if len(col) else np.empty(0, np.int64)
        self.start, self.size = first, np.diff(np.append(first, len(col)))
        self.block = block[first] if len(first) else np.empty(0, np.int64)
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.empty(0)
        self.entries = np.searchsorted(col[first] if len(first) else np.empty(0, np.int64), np.arange(n + 1))
        self.blocks = max(1, -(-len(held) // BLOCK))

    def unit(self, cols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of counts, without components of weight 0; cols in order."""
        w = (1 + np.log(counts)) * self.weight[cols] if len(cols) else np.empty(0)
        cols, w = cols[w > 0], w[w > 0]
        norm = np.sqrt((w * w).sum())
        return (cols, w / norm) if norm else (np.empty(0, np.int64), np.empty(0))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        n = Counter(terms(text))
        known = n.keys() & self.column.keys()
        cols = np.fromiter(map(self.column.__getitem__, known), np.int64, len(known))
        order = np.argsort(cols)
        return self.unit(cols[order], np.fromiter(map(n.__getitem__, known), np.float64, len(known))[order])

    def nearest(self, cols: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a positive cosine, nearest first, ties to the smaller index."""
        if not len(cols):
            return []
        n = self.entries[cols + 1] - self.entries[cols]
        e, w = _spread(self.entries[cols], n), np.repeat(weights, n)
        at = self.block[e]
        bounds = np.bincount(at, w * self.most[e], self.blocks) + 1e-12
        order = np.argsort(-bounds, kind="stable")
        best: list[tuple[float, int]] = []
        done, step = 0, 4
        while done < len(order):
            # first a few blocks for a k-th cosine, then all that can still reach it
            some = order[done : done + step]
            some = some[bounds[some] >= (best[-1][0] if len(best) == k else 2e-12)]
            if not len(some):
                break
            done, step = done + step, len(order)
            chosen = np.zeros(self.blocks, bool)
            chosen[some] = True
            mine = np.flatnonzero(chosen[at])
            own = e[mine]
            size = self.size[own]
            p = _spread(self.start[own], size)
            sums = np.round(np.bincount(self.example[p], np.repeat(w[mine], size) * self.value[p], len(self.ids)), 12)
            hit = np.flatnonzero(sums >= best[-1][0] if len(best) == k else sums > 0)
            if len(hit) > 4 * k:
                # only those that are not beaten by k others
                hit = hit[sums[hit] >= np.partition(sums[hit], len(hit) - k - 1)[len(hit) - k - 1]]
            found = [(float(c), i) for c, i in zip(sums[hit].tolist(), self.place[hit].tolist(), strict=True) if i != without and c > 0]
            best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The neighbours' weighted share of label 1; -1 without neighbours."""
        if not near:
            return -1.0
        weights = [1.0 / (1.0 - min(1.0, c) + 0.1) for c, _ in near]
        return sum(w for w, (_, i) in zip(weights, near, strict=True) if self.ones[i]) / sum(weights)

    def calibrate(self, share: float, k: int) -> None:
        """Fit vote -> probability at a share of label 1 of all labelled rows, each example scored without itself."""
        self.prior = share
        n1 = max(1, int(self.labels.sum()))
        n0 = max(1, len(self.labels) - n1)
        weight = {1: share / n1, 0: (1 - share) / n0}
        points: dict[float, list[float]] = {}
        for i, y in enumerate(self.labels.tolist()):
            p = points.setdefault(round(self.vote(self.nearest(*self.unit(*self.counts[i]), k, without=i)), 3), [0.0, 0.0])
            p[0] += weight[y] * y
            p[1] += weight[y]
        runs: list[list[float]] = []
        for v in sorted(points):
            runs.append([v, points[v][0], points[v][1], v])
            while len(runs) > 1 and runs[-2][1] * runs[-1][2] >= runs[-1][1] * runs[-2][2]:
                _, a, b, hi = runs.pop()
                runs[-1][1] += a
                runs[-1][2] += b
                runs[-1][3] = hi
        # one example of each label, weighed down, keeps a run off 0 and 1
        pad = 1.0 / (len(self.labels) + 2)
        x = [z for v, _, _, hi in runs for z in (v, hi)]
        y = [z for _, a, b, _ in runs for z in [(a + pad * share) / (b + pad)] * 2]
        self.table = np.array(x), np.array(y)

    def score(self, text: str | None, k: int = NEIGHBOURS) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(*self.vector(text), k)
        vote = self.vote(near)
        # a trace of the raw vote keeps the order of scores inside a flat run of the table
        flat = float(np.interp(vote, *self.table)) if self.table is not None and len(self.table[0]) else self.prior
        return min(1.0, max(0.0, 0.999 * flat + 0.001 * max(0.0, vote))), near


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Index:
    """The index, from labelled rows that are not held out; IDF from all documents."""
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, min(1.0, examples / max(1, count.get(1, 0)))).otherwise(min(1.0, examples / max(1, count.get(0, 0))))
    # the chosen doc_ids are bounded by the sample, so they may go to every task
    chosen = known.where(at < share).limit(4 * examples)

    @F.pandas_udf("terms string, counts binary")
    def counted(text: pd.Series) -> pd.DataFrame:
        found = [Counter(terms(t)) for t in text]
        return pd.DataFrame({"terms": [" ".join(x) for x in found], "counts": [np.array(list(x.values()), np.int32).tobytes() for x in found]})

    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    number: dict[str, int] = {}
    held = []
    # one partition's lists of terms are on the driver at a time; what stays are numbers, and each term once
    for r in one.select("doc_id", "toxic", counted("text").alias("c")).select("doc_id", "toxic", "c.terms", "c.counts").toLocalIterator():
        cols = np.array([number.setdefault(t, len(number)) for t in (r["terms"].split(" ") if r["terms"] else [])], np.int32)
        order = np.argsort(cols)
        held.append((r["doc_id"], r["toxic"], cols[order], np.frombuffer(r["counts"], np.int32)[order]))
    held.sort(key=lambda x: x[0])
    ids, toxic, held = [x[0] for x in held], [x[1] for x in held], [x[2:] for x in held]
    every = list(number)
    with_ = {y: np.bincount(np.concatenate([c for (c, _), z in zip(held, toxic, strict=True) if z == y] or [np.empty(0, np.int32)]), minlength=len(every)).astype(float) for y in (0, 1)}
    told = relevance(with_[1], with_[0], toxic.count(1), toxic.count(0))
    total, df = _frequencies(docs, every)
    out = Index(every, (np.log((1 + total) / (1 + df)) + 1.0) * told, ids, toxic, held)
    out.calibrate(count.get(1, 0) / max(1, sum(count.values())), k)
    return out


def _frequencies(docs: DataFrame, every: list[str]) -> tuple[int, np.ndarray]:
    """(documents, document frequency of each term) over all of docs."""
    out = np.zeros(len(every), np.int64)
    if not every:
        return docs.count(), out
    sent = docs.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column, n = {t: i for i, t in enumerate(sent.value)}, 0
        df = np.zeros(len(column), np.int64)
        for pdf in batches:
            gc.disable()
            found = [column.keys() & set(terms(text)) for text in pdf["text"]]
            gc.enable()
            df += np.bincount(np.fromiter(map(column.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found))), minlength=len(df))
            n += len(found)
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(some, -1), "n": np.append(df[some], n)})

    found = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (found.column(c).to_numpy() for c in ("term", "n"))
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def scores(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, evidence (doc_id and cosine of the neighbours); only texts go to Python, ids stay as they are."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, doc_id array<long>, cosine array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for texts in batches:
            # only plain values are made here: the collector would look for cycles in vain
            gc.disable()
            rows = [held.score(t, k) for t in texts]
            gc.enable()
            yield pd.DataFrame({"score": [p for p, _ in rows], "doc_id": [held.ids[[i for _, i in near]] for _, near in rows], "cosine": [np.array([c for c, _ in near]) for _, near in rows]})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text")).alias("x"))
    return scored.select("doc_id", "x.score", F.arrays_zip(F.col("x.doc_id").alias("doc_id"), F.col("x.cosine").alias("cosine")).alias("evidence"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
