"""WARC archives with a two-level capture index.

Write: each task appends the records of its rows to an archive of its own, one gzip member a record, and rolls over to a
new file after ``FILE_BYTES``.  Of equal payloads the record with the largest page_id is the response; the others are
revisits that name it and carry only the original's HTTP headers, with its length.  Files are named by a random part, and
only those that the manifest (the rows that successful tasks returned, written once) names are ever read, so
tasks may fail, run again or run twice.

Index: capture lines, keyed by the URL with its host reversed, are range-partitioned and sorted; each task writes compressed
blocks of ``BLOCK_LINES`` lines and returns the sparse directory: first and last key, place and length of each block.

Read: ``lookup`` finds the blocks of each wanted key by binary search in the directory, reads each of these blocks once, finds the lines
by binary search in the block, then range-reads the records.  ``read_all`` goes through every block of the directory.
A directory of more than ``MOST_BLOCKS`` rows is itself cut at ``CUTS`` of its keys, and searched part by part.

Cases: a null html is an empty payload; a null URL is an empty one.  Among rows that repeat both payload and largest page_id all
are responses.  A null page_id is a response only if no equal payload has an id.  Control characters in URLs are percent-encoded.
Payloads of any length are written whole.  Empty tables make empty archives.  Extra columns are ignored.  Ids travel as 64-bit
whole numbers, null or not.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import scratch, short_batches, staged, table

FILE_BYTES, BLOCK_LINES, LEVEL, LEAST_BYTES = 64 << 20, 512, 3, 0
LINES_PER_RANGE = 50_000
#: Rows of the block directory that go to a task, and keys at which a larger directory is cut (about 100 bytes each).
MOST_BLOCKS, CUTS = 100_000, 50_000
#: Payload digests that occur again: so many (about 30 bytes each) go to every task, more are joined by a shuffle.
MOST_SENT = 500_000

_LINE = "key string, page_id long, path string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: com,example,www)/path?query."""
    text = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f")/{text}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "") + ")" + rest


def opened(path: str):
    """(file system, path in it) of a URI; works for every store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the headers of the original but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe="!#$%&'()*+,/:;=?@[]~-._")}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    raw = zlib.decompress(member, 31)
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "replace").split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Archive:
    """manifest: a capture line of each record; directory: the sparse block directory."""

    def __init__(self, manifest: DataFrame, directory: DataFrame) -> None:
        self.manifest, self.directory = manifest, directory


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> Archive:
    """Write pages (page_id, url, html) to WARC files in folder, which all executors must reach, and index them."""
    spark = pages.sparkSession
    short_batches(spark, 128)
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    # only payloads that occur again need a partner; who that is, is settled on digests and ids alone
    first = staged(rows.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sha", "keeper"), "keepers")
    first = F.broadcast(first) if first.count() <= MOST_SENT else first
    keeper = F.when(F.octet_length("html") >= least, F.col("keeper"))
    ready = rows.join(first, "sha", "left").select("page_id", "url", "html", "sha", F.when(keeper.isNotNull() & ~F.col("page_id").eqNullSafe(keeper), keeper).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = opened(folder)
        store.create_dir(inside, recursive=True)
        out, path, at, sent = None, "", 0, []
        for batch in batches:
            for page_id, url, html, sha, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "refers_to")], strict=True):
                if out is None:
                    path, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{inside}/{path}", compression=None)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), sha, refers)
                out.write(member)
                sent.append((url_key(url), page_id, f"{folder}/{path}", at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if sent and out is None:
                yield _batch(sent, _LINE)
                sent = []
        if out is not None:
            out.close()
        if sent:
            yield _batch(sent, _LINE)

    manifest = staged(ready.mapInArrow(put, _LINE), "manifest")
    return Archive(manifest, index(manifest, f"{folder}/index"))


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as Arrow columns of the types of schema; whole numbers never pass through floats."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """The block directory: first, last, lines, path, offset, length."""
    ranges = max(1, -(-manifest.count() // LINES_PER_RANGE))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = opened(folder)
        store.create_dir(inside, recursive=True)
        out, name, at, lines, made = None, "", 0, [], []

        def flush() -> None:
            nonlocal out, name, at
            if out is None:
                name = f"index-{uuid.uuid4().hex}.cdx"
                out = store.open_output_stream(f"{inside}/{name}", compression=None)
            block = zlib.compress("\n".join(f"{x[0]} {json.dumps(x[1:], separators=(',', ':'))}" for x in lines).encode(), 6)
            out.write(block)
            made.append((lines[0][0], lines[-1][0], len(lines), f"{folder}/{name}", at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for line in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "path", "offset", "length")], strict=True):
                lines.append(line)
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        yield _batch(made, _BLOCK)

    # page_id in the key lets a URL that a third of all captures share be dealt over many ranges
    lined = manifest.repartitionByRange(ranges, "key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")
    return staged(lined.mapInArrow(put, _BLOCK), "directory")


_BLOCK = "first string, last string, lines long, path string, offset long, length long"


class Ranges:
    """Reads ranges of files, keeping the last files open."""

    def __init__(self) -> None:
        self.files: dict[str, object] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            store, inside = opened(path)
            self.files[path] = store.open_input_file(inside)
        return self.files[path].read_at(length, offset)


def _block(files: Ranges, path: str, offset: int, length: int) -> list[tuple[str, list]]:
    lines = (x.partition(" ") for x in zlib.decompress(files.read(path, offset, length)).decode().split("\n"))
    return [(k, json.loads(v)) for k, _, v in lines]


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _row(member: bytes, with_payload: bool) -> tuple:
    number = lambda x: int(d) if (d := x.rpartition(":")[2].rstrip(">")) else None
    warc, http, payload = parsed(member)
    kind, stated = warc["warc-type"], warc["warc-payload-digest"].partition(":")[2]
    if kind == "response" and (got := base32(hashlib.sha1(payload).digest())) != stated:
        raise ValueError(f"payload of {warc['warc-record-id']} has digest {got}, not {stated}")
    size = len(payload) if kind == "response" else int(http["content-length"])
    return number(warc["warc-record-id"]), warc["warc-target-uri"], size, stated, kind, number(warc["warc-refers-to"]) if "warc-refers-to" in warc else None, payload if with_payload else None


def read_all(archive: Archive, with_payload: bool = False) -> DataFrame:
    """Every record, through the index: blocks, then the ranges that their lines name, in the order of the files."""
    spark = archive.directory.sparkSession
    short_batches(spark, 128)
    blocks = max(1, min(10_000, archive.directory.count()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for place in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True):
                yield from _records(files, [x for _, x in _block(files, *place)], with_payload)

    return archive.directory.repartition(blocks).mapInArrow(get, _RECORD)


def _records(files: Ranges, lines: list[list], with_payload: bool) -> Iterator[pa.RecordBatch]:
    lines = sorted(lines, key=lambda x: (x[1], x[2]))
    for k in range(0, len(lines), 64):
        yield _batch([_row(files.read(*x[1:]), with_payload) for x in lines[k : k + 64]], _RECORD)


def blocks_of(directory: DataFrame, wanted: DataFrame, most: int = MOST_BLOCKS, cuts: int = CUTS) -> DataFrame:
    """key, path, offset, length: the blocks that may hold each of wanted (key, distinct), by binary search in the directory."""
    hit = "key string, path string, offset long, length long"
    n = directory.count()
    if n <= most:
        few = directory.orderBy("first", "last", "path", "offset").collect()
        firsts, lasts, places = [r["first"] for r in few], [r["last"] for r in few], [(r["path"], r["offset"], r["length"]) for r in few]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # blocks are sorted and touch at most in one key, so both lists are in order
                yield _batch([(k, *p) for k in batch.column("key").to_pylist() for p in places[bisect.bisect_left(lasts, k) : bisect.bisect_right(firsts, k)]], hit)

        return wanted.mapInArrow(search, hit)
    # about so many first keys cut the directory into parts; a block that reaches over a cut is in several parts
    at = sorted({r["first"] for r in directory.where(F.pmod(F.xxhash64("first", "path", "offset"), F.lit(max(1, n // cuts))) == 0).select("first").collect()})
    low = F.pandas_udf(lambda s: s.map(lambda k: bisect.bisect_left(at, k)), "int")
    parts = directory.withColumn("part", F.explode(F.sequence(low("first"), low("last"))))

    def search_part(wanted_: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["first", "last", "path", "offset"])
        firsts, lasts, places = blocks["first"].tolist(), blocks["last"].tolist(), list(zip(blocks["path"], blocks["offset"].tolist(), blocks["length"].tolist(), strict=True))
        found = [(k, *p) for k in wanted_["key"] for p in places[bisect.bisect_left(lasts, k) : bisect.bisect_right(firsts, k)]]
        return pd.DataFrame(found, columns=["key", "path", "offset", "length"])

    return wanted.withColumn("part", low("key")).groupBy("part").cogroup(parts.groupBy("part")).applyInPandas(search_part, hit)


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", with_payload: bool = True, most: int = MOST_BLOCKS) -> DataFrame:
    """The records of given URLs: binary search in the directory, then in the block, then range reads."""
    spark = urls.sparkSession
    short_batches(spark, 128)
    keys = F.pandas_udf(lambda s: s.map(url_key, na_action=None), "string")
    wanted = urls.select(keys(F.col(url_col)).alias("key")).distinct()
    # the keys of a block meet in one task, so that it is read once
    hits = blocks_of(archive.directory, wanted, most).repartition("path", "offset").sortWithinPartitions("path", "offset", "key")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place, block = Ranges(), None, []
        for batch in batches:
            lines = []
            for key, *here in zip(*[batch.column(c).to_pylist() for c in ("key", "path", "offset", "length")], strict=True):
                if here != place:
                    place, block = here, _block(files, *here)
                at = bisect.bisect_left(block, key, key=lambda x: x[0])
                while at < len(block) and block[at][0] == key:
                    lines.append(block[at][1])
                    at += 1
            yield from _records(files, lines, with_payload)

    return hits.mapInArrow(get, _RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by its URL, through the index."""
    pages = table(spark, sf_dir, "pages")
    return lookup(write(pages), pages, with_payload=False).drop("payload", "url")
