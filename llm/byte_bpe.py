"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

Encoding: a piece that is a token is joined to the vocabulary.  Rows (piece, position, token) of the others join the merge table;
every step contracts each piece's leftmost pair of minimum rank, until no pair of any piece can merge.  An ordered aggregation lists
the ids of a piece.  Decoding: rows (list, position, id) join the vocabulary, and an ordered aggregation joins their bytes; it sees ids
only.  A worker keeps the ids of pieces that it has met twice, and the bytes that these ids decode to (``Memory``), so a partition sends
only new pieces and their id lists to DuckDB; a text decodes to the bytes of its id lists, one after the other.
DuckDB is opened for a task and closed with it; texts are worked on in segments of bounded length, whose digests are carried on.

Cases: a null or empty text has no tokens and decodes to no bytes.  Lone surrogates cannot occur in Spark strings.
Pieces over ``LONG`` bytes are merged outside DuckDB by the same rule with a heap, as they would need as many steps
as bytes.  Texts of any length are cut between pieces, never inside one, where a single space joins two other characters.  Repeated rows are encoded each on its own; an empty table
gives an empty result.  Extra columns pass through; a new column whose name is taken gets a prefix (``bpe_``), until it is free.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import heapq
import pickle
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import fresh, short_batches, table

#: Bytes of a piece that DuckDB merges, and characters of a segment (about).
LONG, SEGMENT = 1024, 500_000


class Room(NamedTuple):
    """What a worker holds at once: characters of text, state rows of one recursive query (a piece of n bytes has at most n * n), young and hot entries."""

    chars: int
    rows: int
    young: int
    hot: int


#: About 330 MB a worker, for encoding by itself; about 220 MB, beside what other operators hold in a pipeline (a fifth more time).
WIDE, NARROW = Room(4_000_000, 4_000_000, 150_000, 150_000), Room(1_000_000, 1_000_000, 40_000, 60_000)

_WHOLE = "SELECT s.w, v.id FROM pieces s JOIN vocabulary v ON v.raw = s.raw"
_STEPS = """
WITH RECURSIVE t(step, w, p, tok) AS (
    SELECT 0, w, p, tok FROM start
  UNION ALL
    SELECT step + 1, w, CASE WHEN p > spot THEN p - 1 ELSE p END, CASE WHEN p = spot THEN merged ELSE tok END
    FROM (
        SELECT t.step, t.w, t.p, t.tok, b.best // 4096 AS merged, b.best % 4096 AS spot
        FROM t JOIN (
            -- the least (rank, position) of each piece, as one number: a piece has fewer than 4096 positions
            SELECT n.w, min(m.merged * 4096 + n.p) AS best
            FROM t n JOIN t f ON f.w = n.w AND f.p = n.p + 1 JOIN merges m ON m.lhs = n.tok AND m.rhs = f.tok
            GROUP BY n.w
        ) b ON b.w = t.w
    )
    WHERE p <> spot + 1
), last AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT t.w, string_agg(CAST(t.tok AS VARCHAR), ' ' ORDER BY t.p) AS ids FROM t JOIN last USING (w, step) GROUP BY t.w
"""
_DECODE = "SELECT c.i, string_agg(v.hex, '' ORDER BY c.k) FROM coded c JOIN vocabulary v ON v.id = c.t GROUP BY c.i"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memory:
    """(ids, bytes) by piece: new ones are young, those met again are hot. Too many young ones are let go, too many hot ones become young."""

    def __init__(self, room: Room = WIDE) -> None:
        self.room = room
        self.young: dict[str, tuple[str, bytes]] = {}
        self.hot: dict[str, tuple[str, bytes]] = {}
        self.packed = pickle.dumps({})

    def unpack(self) -> None:
        self.hot = pickle.loads(self.packed)

    def pack(self) -> None:
        """Between tasks: the hot entries as one block, as many small ones would hold on to the memory around them."""
        self.packed = pickle.dumps(self.hot)
        self.young, self.hot = {}, {}

    def of(self, lists: list[list[str]], make: Callable[[list[str]], dict]) -> list[list[tuple[str, bytes]]]:
        """What is known of each list of pieces; make gives it for those that are not remembered."""
        keys = set().union(*lists)
        if len(self.hot) > self.room.hot:
            self.young, self.hot = self.hot, {}
        new = keys - self.hot.keys()
        for k in new & self.young.keys():
            self.hot[k] = self.young.pop(k)
        new -= self.hot.keys()
        if len(self.young) > self.room.young:
            self.young.clear()
        if new:
            self.young |= make(list(new))
        hot, young = self.hot.get, self.young
        at = {k: hot(k) or young[k] for k in keys}.__getitem__
        return [list(map(at, x)) for x in lists]


class Codec:
    """One worker's merge table and memory, and the DuckDB of a task."""

    def __init__(self, path: str, pattern: str) -> None:
        import pyarrow as pa
        import regex

        self.ranks, self.find = read_ranks(path), regex.compile(pattern).findall
        lhs, rhs, merged = [], [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    lhs.append(a), rhs.append(b), merged.append(i)
        self.byte_rank = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.merges = pa.table({"lhs": pa.array(lhs, pa.int32()), "rhs": pa.array(rhs, pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "raw": pa.array(list(self.ranks), pa.binary()), "hex": [b.hex() for b in self.ranks]})
        self.memory = Memory()

    def __enter__(self) -> Codec:
        import duckdb

        # in memory only: an executor's own folder is not for spilling, and one query's state is bounded
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self._put("merges", self.merges)
        self._put("vocabulary", self.vocabulary)
        self.memory.unpack()
        return self

    def __exit__(self, *_) -> None:
        """Keep hot entries only, and give memory back, as other operators' tasks run in this worker too."""
        self.db.close()
        self.memory.pack()
        trim()

    def _put(self, name: str, rows) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _ids_of_pieces(self, pieces: list[str]) -> dict[str, str]:
        """Ids, joined by a space, of each piece: of tokens by the vocabulary, of others by the recursive query."""
        import pyarrow as pa

        raw = [p.encode("utf-8") for p in pieces]
        self._put("pieces", pa.table({"w": np.arange(len(raw), dtype=np.int32), "raw": pa.array(raw, pa.binary())}))
        # a piece that is a token is that token, as in the tiktoken library, whether or not merges lead to it
        out = {pieces[w]: str(i) for w, i in self.db.execute(_WHOLE).fetchall()}
        rest: list[int] = []
        rows = 0
        for w, b in enumerate(raw):
            if pieces[w] in out:
                continue
            if len(b) > LONG:
                out[pieces[w]] = self._merge_long(b)
                continue
            if rows and rows + len(b) ** 2 > self.memory.room.rows:
                self._merge(rest, pieces, raw, out)
                rest, rows = [], 0
            rest.append(w)
            rows += len(b) ** 2
        self._merge(rest, pieces, raw, out)
        return out

    def _merge(self, which: list[int], pieces: list[str], raw: list[bytes], out: dict[str, str]) -> None:
        import pyarrow as pa

        if which:
            size = np.array([len(raw[w]) for w in which])
            w = np.repeat(np.array(which, np.int32), size)
            p = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
            self._put("start", pa.table({"w": w, "p": p, "tok": self.byte_rank[np.frombuffer(b"".join([raw[i] for i in which]), np.uint8)]}))
            for i, ids in self.db.execute(_STEPS).fetchall():
                out[pieces[i]] = ids

    def _merge_long(self, piece: bytes) -> str:
        tok = [self.ranks[bytes([b])] for b in piece]
        raw = [bytes([b]) for b in piece]
        left, right = list(range(-1, len(tok) - 1)), [*range(1, len(tok)), -1]
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (r := self.ranks.get(raw[i] + raw[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if tok[i] == a else -1
            if j < 0 or tok[j] != b:
                continue
            raw[i], tok[i], tok[j], right[i] = raw[i] + raw[j], r, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (q := self.ranks.get(raw[x] + raw[y])) is not None:
                    heapq.heappush(heap, (q, x, tok[x], tok[y]))
        return " ".join(str(t) for t in tok if t >= 0)

    def _decode_lists(self, lists: list[str]) -> dict[str, bytes]:
        """The bytes of lists of ids, each joined by a space."""
        import pyarrow as pa

        if not lists:
            return {}
        size = np.array([x.count(" ") + 1 for x in lists])
        i = np.repeat(np.arange(len(lists), dtype=np.int32), size)
        k = np.arange(len(i), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
        self._put("coded", pa.table({"i": i, "k": k, "t": np.array(list(map(int, " ".join(lists).split(" "))), np.int32)}))
        return {lists[i]: bytes.fromhex(coded) for i, coded in self.db.execute(_DECODE).fetchall()}

    def _both(self, pieces: list[str]) -> dict[str, tuple[str, bytes]]:
        ids = self._ids_of_pieces(pieces)
        raw = self._decode_lists(list(set(ids.values())))
        return {p: (x, raw[x]) for p, x in ids.items()}

    def run(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each piece of each text its ids, joined by a space, and the bytes that the ids decode to."""
        return self.memory.of([self.find(t) for t in texts], self._both)

    def decode(self, coded: list[str]) -> list[bytes]:
        """The bytes of lists of ids, each joined by a space."""
        known = self._decode_lists(list(set(coded) - {""})) | {"": b""}
        return [known[x] for x in coded]


def trim() -> None:
    """Give freed memory back to the system, where Arrow and the C library can."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        return


_CUT = re.compile(r"(?<=\S)(?= \S)")


def segments(text: str | None, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about size characters, cut before a single space between two characters that are not white space.

    The pattern never matches across such a place: only a leading space joins what follows it.
    """
    at, n = 0, len(text or "")
    while at < n:
        m = _CUT.search(text, at + size) if n - at > size else None
        end = m.start() if m else n
        yield text[at:end]
        at = end


class Digest:
    """What is told of one text, part by part."""

    def __init__(self, keep: bool) -> None:
        self.n, self.ids, self.raw, self.kept = 0, hashlib.sha256(), hashlib.sha256(), [] if keep else None

    def add(self, pieces: list[tuple[str, bytes]]) -> None:
        x = " ".join([i for i, _ in pieces])
        if x:
            self.ids.update((" " + x if self.n else x).encode())
            self.n += x.count(" ") + 1
            self.raw.update(b"".join([b for _, b in pieces]))
            if self.kept is not None:
                self.kept.append(x)

    def row(self) -> tuple:
        return (self.n, self.ids.hexdigest(), self.raw.hexdigest(), *([] if self.kept is None else [" ".join(self.kept)]))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, room: Room = WIDE) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    out = _CODECS[path, pattern]
    out.memory.room = room
    return out


def digested(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = False, room: Room = WIDE) -> tuple[DataFrame, str]:
    """docs with a struct column (n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids), and its name."""
    import public_tokenizers

    path, pattern = path or default_ranks(), pattern or public_tokenizers.PATTERN
    short_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * ids)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with codec(path, pattern, room) as c:
            ready: list[list[Digest]] = []
            parts: list[tuple[Digest, str]] = []
            size = 0
            for texts in batches:
                ready.append([Digest(ids) for _ in texts])
                for digest, text in zip(ready[-1], texts, strict=True):
                    for part in segments(text):
                        parts.append((digest, part))
                        size += len(part)
                        if size >= room.chars:
                            finish(c, parts)
                            size = 0
                if not parts:
                    yield from map(frame, ready)
                    ready = []
            finish(c, parts)
            yield from map(frame, ready)

    def finish(c: Codec, parts: list[tuple[Digest, str]]) -> None:
        # only plain values are made here, so that the collector would search millions of them in vain
        gc.disable()
        for (digest, _), pieces in zip(parts, c.run([x for _, x in parts]), strict=True):
            digest.add(pieces)
        parts.clear()
        gc.enable()

    def frame(digests: list[Digest]) -> pd.DataFrame:
        return pd.DataFrame([d.row() for d in digests], columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    name = fresh(docs, "bpe")
    return docs.withColumn(name, run(F.col(text_col))), name


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with bpe_ in front until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"bpe_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def encode(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs with a column token_ids, array<int>."""
    out, c = digested(docs, text_col, ids=True, **kw)
    ids = F.when(F.col(f"{c}.ids") == "", F.array().cast("array<int>")).otherwise(F.split(f"{c}.ids", " ").cast("array<int>"))
    (name,) = _free(docs, "token_ids")
    return out.withColumn(name, ids).drop(c)


def decode(tokens: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """tokens with a column ``decoded`` of bytes, by an ordered aggregation in DuckDB; null ids decode to no bytes."""
    import public_tokenizers

    path, pattern = path or default_ranks(), public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with codec(path, pattern) as c:
            for lists in batches:
                yield pd.Series(c.decode(["" if ids is None else " ".join(map(str, ids)) for ids in lists]), dtype=object)

    (name,) = _free(tokens, "decoded")
    return tokens.withColumn(name, run(F.col(ids_col)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = digested(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", f"{c}.n_tokens", f"{c}.ids_sha256", f"{c}.decoded_sha256")


def tokenised(docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_tokens, ids_sha256, decoded_sha256 (bpe_ before a name that docs has). Every row stays."""
    out, c = digested(docs, room=NARROW)
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], *[F.col(f"{c}.{x}").alias(name) for x, name in zip(made, _free(docs, *made), strict=True)])
