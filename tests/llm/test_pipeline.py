"""The pipeline on a small table: what each stage hands on is held against brute force on what it was given."""

import hashlib

from test_operators import brute_classes, docs, rows  # noqa: F401

from llm import byte_bpe, language_id, mixing, secret_scan


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["text"] or "")


def test_stages_against_brute_force(spark, docs, tmp_path):  # noqa: F811
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline

    token = hashlib.sha1(b"secret").hexdigest()
    base = " ".join(f"water house from the {w}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    more = [(500, f'{base} and the api_key = "{token}" with water from the house', "en", "a"), (501, base, "en", "a"), (502, base + " more", "en", "b"), (None, "the water and the house", "en", "b"), (None, "the water and the house", "en", "b"), (503, "the water of the house", "en", None)]
    table = docs.drop("extra").unionByName(spark.createDataFrame([(*r, len(r[1])) for r in more], "doc_id long, text string, lang string, source string, n_chars long"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        given, out = now, stage(spark, now, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = (sorted(given.collect(), key=key), sorted(now.collect(), key=key))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == table.columns

    given, kept = seen["language_id"]
    engines = language_id.engines_of(language_id.learn(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    assert kept == [r for r in given if not language_id.classify(r["text"], engines)[2]] and len(kept) < len(given)

    given, kept = seen["near_dup"]
    low, _ = brute_classes({r["doc_id"]: r["text"] for r in given if r["doc_id"] is not None}, 5, 80)
    want = {(r["doc_id"], r["text"]) for r in given if r["doc_id"] is None or low[r["doc_id"]] == r["doc_id"]}
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in kept)

    given, clean = seen["secret_scan"]
    found = secret_scan.findings(spark.createDataFrame(given, table.schema), secret_scan.train(spark)).where("is_secret").collect()
    assert {r["value"] for r in found} == {token}
    assert [(r["text"], r["n_chars"]) for r in clean] == [(t := r["text"].replace(token, secret_scan.MARK), r["n_chars"] if t == r["text"] else len(t)) for r in given]

    given, mixed = seen["mixing"]
    words = lambda t: len(t.encode().split())
    sizes: dict = {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want = {s: t for s, _, t in mixing.targets(list(sizes.items()))}
    got: dict = {}
    for r in mixed:
        got[r["source"]] = got.get(r["source"], 0) + words(r["text"])
        assert r["n_chars"] == len(r["text"]) and any(r["doc_id"] == g["doc_id"] and set(r["text"].split()) <= set(g["text"].split()) for g in given)
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in want.items())

    given, coded = seen["byte_bpe"]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r, c in zip(given, coded, strict=True):
        ids = enc.encode_ordinary(r["text"])
        assert (c["text"], c["n_tokens"], c["ids_sha256"], c["decoded_sha256"]) == (r["text"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(r["text"].encode()))


def test_run_of_an_empty_table(spark, docs, tmp_path):  # noqa: F811
    import corpus_pipeline

    docs.drop("extra").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
