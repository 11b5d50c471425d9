"""Language identification by compression.

Each language has a zstandard raw-content dictionary of at most ``DICT_BYTES``: pieces of its labelled texts, drawn by a hash
from the whole texts of a bounded sample of rows, one of each text first, then a second one, until the dictionary is full.  A text
belongs to the language whose dictionary makes it smallest.  Whole texts are used: they are normalised, cut into
pieces of ``CHUNK`` bytes, and the compressed sizes of all pieces are summed.  Where the sizes lie close together, by less than
``CLOSE`` bytes, the text is compressed again by zstandard's optimal parser, which finds matches of three letters.

Letters are those of Unicode (categories L, with their combining marks M); digits, fractions and numbers in circles are none.

Cases: a null text, or one without letters, gets ``und`` with score 0.  With no labelled rows at all every text is
``und``; an empty table gives an empty result.  A language whose labelled texts hold no letters keeps a dictionary of blanks.  Equal sizes go to the language with more labelled rows, then to the smaller name.  Repeated rows are scored
each on its own.  Extra columns pass through untouched.  A null doc_id is never trained on and never held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import fresh, held_out, short_batches, table

CHUNK = 4096
#: Bytes of dictionary for a language, labelled rows drawn for it (about), and characters of a piece.
DICT_BYTES, SAMPLE_DOCS, PIECE = 96 * 1024, 160, 1024
#: zstandard takes no shorter raw dictionary.
LEAST_DICT = 8
#: A lead of fewer bytes is checked by the slower compressor.
CLOSE = 40
#: Nats that a byte of difference counts; a posterior below REJECT_BELOW means the margin is too narrow.
NATS_PER_BYTE, REJECT_BELOW = 1.4, 0.65
UNDETERMINED = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalise(text: str | None) -> bytes:
    """Lower-case letters with single spaces; empty if there is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text and _LETTER.search(text) else b""


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes, float]]:
    """(language, dictionary, nats of its prior), the most frequent language first.

    Reads doc_id, text and lang of rows that are not held out.  The sample is bounded by sample_docs rows for a
    language (about; chosen by a hash of doc_id), and what comes to the driver by dict_bytes for each language.
    """
    short_batches(docs.sparkSession)
    labelled = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))]), F.col("lang"))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.withColumn("at", at).where(F.col("at") < share).distinct()
    cut = chosen.select("lang", "doc_id", "at", F.posexplode(F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{PIECE}}}"), F.lit(0))).alias("i", "piece"))
    mixed = F.xxhash64("doc_id", "i", "piece", F.lit(29))
    turn = F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy(mixed, "i", "piece"))
    first = Window.partitionBy("lang").orderBy("turn", "at", "doc_id", mixed, "i", "piece")
    # pieces beyond the bytes of a dictionary are not collected; its last piece is cut to fit
    size = F.sum(F.octet_length("piece")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    drawn = cut.withColumn("turn", turn).where(F.col("turn") * PIECE <= dict_bytes + PIECE).withColumn("before", F.coalesce(size, F.lit(0))).where(F.col("before") < dict_bytes)
    pieces: dict[str, list] = {}
    for r in drawn.select("lang", "before", "piece").collect():
        pieces.setdefault(r["lang"], []).append((r["before"], normalise(r["piece"])))
    model = []
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        texts = dict.fromkeys(x for _, x in sorted(pieces.get(lang, [])))
        # the nearest bytes cost least to refer to, so what was drawn first goes last
        model.append((lang, b" ".join(reversed(list(texts)))[-dict_bytes:].rjust(LEAST_DICT), -math.log(counts[lang] / sum(counts.values()))))
    return model


def classify(text: str | None, engines: list) -> tuple[str, float, bool]:
    body = normalise(text)
    if not body or not engines:
        return UNDETERMINED, 0.0, True
    pieces = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
    for close in (False, True):
        cost = [NATS_PER_BYTE * sum(len(e[1 + close].compress(p)) for p in pieces) + e[3] for e in engines]
        best = min(cost)
        if sum(c < best + NATS_PER_BYTE * CLOSE for c in cost) == 1:
            break
    score = 1.0 / sum(math.exp(-min(500.0, c - best)) for c in cost)
    return engines[cost.index(best)][0], score, score < REJECT_BELOW


def engines_of(model: list[tuple[str, bytes, float]]) -> list:
    """(language, fast compressor, close compressor, nats of its prior)."""
    import zstandard as zstd

    out = []
    for lang, data, prior in model:
        made = []
        for level, more in ((3, {}), (19, {"min_match": 3, "strategy": zstd.STRATEGY_BTULTRA2})):
            params = zstd.ZstdCompressionParameters.from_level(level, source_size=CHUNK, dict_size=len(data), write_content_size=False, write_checksum=False, write_dict_id=False, **more)
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        out.append((lang, *made, prior))
    return out


def predict(docs: DataFrame, model: list[tuple[str, bytes, float]], text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, a struct (lang_pred, score, rejected), and that column's name."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engines = engines_of(model)
        for texts in batches:
            yield pd.DataFrame([classify(t, engines) for t in texts], columns=["lang_pred", "score", "rejected"])

    name = fresh(docs, "lid")
    return docs.withColumn(name, scored(F.col(text_col))), name


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, c = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), F.col(f"{c}.lang_pred").alias("lang_pred"), F.col(f"{c}.score").alias("score"), F.col(f"{c}.rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is certain enough; narrow margins and texts without letters go."""
    columns = docs.columns
    out, c = predict(docs, learn(docs))
    return out.where(~F.col(f"{c}.rejected")).select(*[F.col(f"`{x}`") for x in columns])
