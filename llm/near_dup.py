"""Near-duplicate classes by bottom-k sketches of one hash function.

1. A document's shingles are hashed with one 64-bit function; its ``k`` smallest values are its sketch.  Documents with
   the same shingle set form one class, so exact copies meet only once, whatever their number.
2. Inverted lists of retained values generate overlaps.  Two classes that reach the threshold share at least ``m``
   retained values (``least_shared``), so each class lists only the rarest ``k - m + 1`` of its own: values of
   passages that many documents share are left out of the lists first.
3. In a list, all members meet the two leaders (smallest id; most widely shared values), never each other.  Linked
   classes merge into components; then the members of a list that are not in its largest component meet members of
   other components.  Pairs inside a component are never built, so a group of copies costs as much as it has members,
   and no link between different components is lost.  Sizes and places in the lists bound what two classes can share:
   groups of members whose bound falls short are passed over as groups, before any pair is built.  Where a list would
   still give more than ``WIDE`` pairs, its members are listed anew under all their shingles, the rarest first, and the same
   bounds, now exact, decide which of them meet.
4. The sketch of the union estimates the similarity of a pair and filters; the full hashed sets confirm.

Classes of at most ``k`` shingles are compared by their whole sets, so none of their links is lost.  For larger ones the sketches are a
sample: a linked pair shares fewer than ``m`` values, and is missed, with a chance of at most ``MISS``.

Cases: a null text, or one without words, has no shingles and links with nothing.  A text with fewer than ``words``
words is one shingle.  Repeated rows are one class.  Rows that share a doc_id but not the text count as one node.  A row
with a null doc_id gets a null component and is not kept.  An empty table gives an empty result.  Only doc_id and text are
read, so extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import short_batches, staged, table

#: Retained values, and the chance that a linked pair of classes with more than SKETCH shingles may be missed with.
SKETCH, MISS = 32, 1e-7
#: Pairs from one list beyond which its members are listed by their full sets.
WIDE = 4096
#: Most bits of a filter of wanted ids (32 MB on the driver and in each Python worker), those of one of its blocks, and bits
#: for each id.  More ids than that are joined instead.
FILTER_BITS, BLOCK_BITS, BITS_AN_ID = 1 << 28, 1 << 15, 16
#: Word hashes that a Python worker keeps from text to text (some 200 bytes each); all are let go beyond that.
CACHED_WORDS = 1 << 16


def least_shared(percent: int, miss: float = MISS) -> int:
    """The most retained values of a union that two classes may be asked to share, so that a linked pair is missed with a chance of at most miss.

    Each of the SKETCH smallest hashes of a union is common with the pair's similarity, and is then retained by both, also where one
    contains the other; without replacement, so the binomial tail is an upper bound.
    """
    j, tail = percent / 100.0, 0.0
    for m in range(SKETCH + 1):
        tail += math.comb(SKETCH, m) * j**m * (1 - j) ** (SKETCH - m)
        if tail > miss:
            return max(1, m)
    return SKETCH


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; known caches word hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(parts).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    width = min(words, len(parts))
    acc = np.full(n, np.uint64(width))
    for i in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


def _filter_of(ids: DataFrame) -> tuple[int, Broadcast] | None:
    """A bit filter of ids (doc_id, distinct), as its size in bits and its bytes; None where it would pass FILTER_BITS."""
    bits = 1 << max(BLOCK_BITS.bit_length() - 1, (BITS_AN_ID * ids.count()).bit_length())
    if bits > FILTER_BITS:
        return None

    def packed(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK_BITS, bool)
        flags[pdf["at"].to_numpy() % BLOCK_BITS] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    blocks = ids.select(_place(bits).alias("at")).distinct().groupBy(F.floor(F.col("at") / BLOCK_BITS).alias("block")).applyInPandas(packed, "block long, bits binary")
    whole = bytearray(bits // 8)
    for block, part in blocks.toLocalIterator():
        whole[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = part
    return bits, ids.sparkSession.sparkContext.broadcast(bytes(whole))


def _place(bits: int) -> Column:
    return F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))


def sets_of_ids(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, n, hashes (the whole set, eight bytes each) of the rows of docs whose doc_id is in ids (doc_id, distinct), and of
    a few others: a bit filter of the ids, of checked size, goes to the texts, so that these are not shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sent = _filter_of(ids)
    docs = docs.withColumn("at", _place(sent[0])) if sent else docs.join(ids, "doc_id", "left_semi").withColumn("at", F.lit(0).cast("long"))
    held = sent and sent[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        bits = held and np.frombuffer(held.value, np.uint8)
        for pdf in batches:
            if held:
                at = pdf["at"].to_numpy()
                pdf = pdf[bits[at >> 3] >> (7 - (at & 7)) & 1 == 1]
            sets = [shingle_hashes(t, words, known).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["doc_id"].to_numpy(), "n": np.array([len(x) // 8 for x in sets], np.int64), "hashes": pd.Series(sets, dtype=object)})

    return docs.mapInPandas(run, "id long, n long, hashes binary")


def _as_longs(sets: DataFrame) -> DataFrame:
    """id, n, sketch: all hashes of each set, as signed longs."""

    @F.pandas_udf("array<long>")
    def longs(hashes: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in hashes], dtype=object)

    return sets.select("id", "n", longs("hashes").alias("sketch"))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set), sketch (its SKETCH smallest values, as signed longs).

    Only texts go to Python: ids, null or not, stay whole numbers.
    """

    @F.pandas_udf("n_shingles long, set_key binary, sketch array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        known: dict[bytes, int] = {}
        for texts in batches:
            rows = []
            for text in texts:
                h = shingle_hashes(text, words, known)
                key = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                rows.append((len(h), key, h[:SKETCH].view(np.int64) if len(h) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text")).alias("x")).select("doc_id", "x.n_shingles", "x.set_key", "x.sketch")


def _lists(classes: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """(value, id, weight, n, place): the inverted lists; weight is how widely the values of id are shared, place the
    rarity of the value among those of id (1: the rarest), n the number of shingles.

    classes: id, n, sketch. whole: sketch holds the full set; else n over SKETCH is given as SKETCH + 1.
    """
    entries = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    all_of_them = F.ceil(F.col("n") * percent / F.lit(100.0))
    held = F.col("n") if whole else F.least(F.col("n"), F.lit(SKETCH))
    # the largest partner of a small set drops what it has over SKETCH; smaller partners drop less than they ask for less
    largest = F.floor(F.col("n") * 100 / F.lit(float(percent)))
    beside = F.ceil((F.col("n") + largest) * percent / F.lit(100.0 + percent)) - F.greatest(largest - SKETCH, F.lit(0))
    least = all_of_them if whole else F.when(F.col("n") <= SKETCH, F.least(all_of_them, beside)).otherwise(F.lit(least_shared(percent)))
    own = entries.join(shared, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"), F.sum("df").alias("weight"))
    # values that nobody else has are the rarest: they take the first places of a class, and list nothing
    alone = held - F.size("found")
    own = own.withColumn("alone", alone).withColumn("open", (held - least + 1 - F.col("alone")).cast("int")).where("open > 0")
    n = F.col("n") if whole else F.least("n", F.lit(SKETCH + 1))
    return own.select("id", "weight", n.cast("int").alias("n"), "alone", F.posexplode(F.slice("found", F.lit(1), F.col("open"))).alias("at", "x")).select("x.value", "id", "weight", "n", (F.col("alone") + F.col("at") + 1).cast("int").alias("place"))


def _leader_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with its two leaders."""
    lead = lists.groupBy("value").agg(F.min("id").alias("low"), F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("wide"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = lists.join(lead.select("value", F.array_distinct(F.array("low", -F.col("wide.minus"))).alias("leaders")), "value").select("id", F.explode("leaders").alias("leader")).where("id <> leader")
    return met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _live(lists: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the lists that hold several components, with their own and the list's largest component (c, major), and
    the number of pairs that the list could give."""
    placed = lists.select("value", "id", "n", "place").join(component, "id", "left").select("value", "id", "n", "place", F.coalesce("component", "id").alias("c"))
    sizes = placed.groupBy("value", "c").agg(F.count(F.lit(1)).alias("m"))
    lists_ = sizes.groupBy("value").agg(F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("all")).where("parts > 1")
    return staged(placed.join(lists_.select("value", F.col("top.c").alias("major"), (F.col("all") * (F.col("all") - F.col("top.m"))).alias("most")), "value"), "live")


def _met(live: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of a list in different components; members of the largest meet only the others."""
    minor = live.where("c <> major").select("value", "n", "place", F.col("id").alias("i"), F.col("c").alias("ci"))
    # both have their rarer values to themselves at best: what is left must reach the overlap that their sizes ask for
    kinds = live.select("value", F.col("n").alias("n2"), F.col("place").alias("place2")).distinct()
    exact = F.lit(True) if whole else (F.col("n") <= SKETCH) & (F.col("n2") <= SKETCH)
    needed = F.ceil((F.col("n") + F.col("n2")) * percent / F.lit(100.0 + percent))
    reach = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1 >= needed
    viable = minor.select("value", "n", "place").distinct().join(kinds, "value").where(~exact | reach)
    others = live.select("value", F.col("n").alias("n2"), F.col("place").alias("place2"), "id", "c")
    met = minor.join(viable, ["value", "n", "place"]).join(others, ["value", "n2", "place2"]).where("ci <> c")
    return met.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b"))


def _crossing_pairs(lists: DataFrame, component: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of a list that lie in different components."""
    live = _live(lists, component)
    pairs = _met(live.where(F.col("most") <= WIDE), percent, False)
    wide = staged(live.where(F.col("most") > WIDE).select("id").distinct(), "wide")
    if wide.limit(1).count():
        sets = staged(sets_of_ids(docs, wide.withColumnRenamed("id", "doc_id"), words), "sets").join(nodes.join(wide, "id", "left_semi").select("id", "n").distinct(), ["id", "n"], "left_semi")
        sets = staged(_as_longs(sets), "fullsets")
        pairs = pairs.union(_met(_live(staged(_lists(sets, percent, whole=True), "lists"), component), percent, True))
    return pairs.distinct()


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and the sketch of the union do not rule out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union(_unsigned("sa"), _unsigned("sb"))), 1, SKETCH)
    common = F.array_intersect(F.array_intersect(_unsigned("sa"), _unsigned("sb")), union)
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    shared = F.size(F.array_intersect("sa", "sb"))
    exact = 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)
    return both.where(F.when(whole, exact).otherwise(F.size(common) >= F.lit(least_shared(percent)))).select("a", "b")


def _unsigned(name: str):
    """Sketch values in the order of the hash, which is unsigned."""
    return F.transform(F.col(name), lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    sets = staged(sets_of_ids(docs, needed, words), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return 100 * both >= percent * (len(p) + len(q) - both)

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype=bool)

    return both.where(linked("ha", "hb")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (a, b). Alternates large and small stars."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = staged(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == seen:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
        mark = seen


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs (doc_id, text)."""
    short_batches(docs.sparkSession)
    rows = staged(sketches(docs, words), "sketches")
    classes = staged(
        rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x")).select("set_key", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sketch")), "classes"
    )
    lists = staged(_lists(classes, percent), "lists")
    # of a doc_id with several texts, one node
    nodes = classes.select("id", "n", "sketch")
    first = staged(_confirmed(staged(_filtered(_leader_pairs(lists), nodes, percent), "pairs"), docs, words, percent), "links")
    found = staged(components(first), "components")
    rest = staged(_filtered(_crossing_pairs(lists, found, docs, nodes, words, percent), nodes, percent), "pairs")
    if rest.limit(1).count():
        found = components(first.union(_confirmed(rest, docs, words, percent)))
    place = classes.select("set_key", "id").join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("of_class"))
    return rows.drop("sketch").join(place, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("of_class", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def keep_first_of_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. 

    Rows with the same doc_id and text are kept once, the first by source, lang and n_chars; different texts all stay, also under one
    doc_id or none. Rows with a null doc_id are grouped only with equal texts.
    """
    drop = near_duplicates(docs, words, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(*[F.col(c) for c in ("source", "lang", "n_chars") if c in docs.columns], F.col("text"))
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order)
    return left.groupBy("doc_id", "text").agg(row.alias("row")).select("row.*")


