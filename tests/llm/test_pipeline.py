"""The pipeline against its stages' plain forms, on the smallest documents with odd rows added."""

import hashlib
import struct

import public_tokenizers
import pytest

import corpus_pipeline
from keyloom.llm import bpe, decontaminate, langid, secrets

from .test_jaccard import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(COLUMNS)
    first = [r.text for r in docs.orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [
        (9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, first[0], "en", "s", 1), (9004, first[0].encode().upper().decode(), "en", "s", 1), (9005, " ".join(first[1].split()[::-1]) + " " + item, "en", "s", 1),
        (9006, " ".join(first[2].split()[::-1]) + " token = 'abcdefghijkl0123456789'", "en", "s", 1), (9007, "12345 !!", "en", "s", 8), (9008, first[2] + " ", "en", "s", 1),
    ]
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


def expected(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classify = langid.Classifier(langid.fit(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows for lang, m in [classify(t)] if lang != "und" and m >= langid.MIN_MARGIN]
    least = {(i, c) for i, _, c in brute(rows)}
    rows = [(i, t) for i, t in rows if (i, i) in least]
    match = decontaminate.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], decontaminate.RATE, decontaminate.MIN_CHARS)
    rows = [(i, t) for i, t in rows if not match(t)]
    spans = {r.doc_id: r.spans for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    enc = bpe.Codec(open(public_tokenizers.path(corpus_pipeline.RANKS), "rb").read(), public_tokenizers.PATTERN).enc
    out = []
    for i, t in rows:
        cut, at = "", 0
        for s in spans[i]:
            cut += t[at : s.a] + secrets.REDACTED if s.a >= at else ""
            at = max(at, s.b)
        t = cut + t[at:]
        ids = enc.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_equals_plain_stages(spark, folder):
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert got == expected(spark, folder)
    kept = {r[0] for r in got}
    assert not {9001, 9002, 9003, 9004, 9005, 9007, 9008} & kept
    assert 9006 in kept and len(kept) > 100


def test_stages(spark, folder, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, folder)
        assert out.collect() == [] and (k == 4 or out.columns == COLUMNS and out.dtypes == none.dtypes)
