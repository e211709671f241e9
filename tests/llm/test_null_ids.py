"""Rows without an id are rows like others; their id stays null."""

import public_tokenizers as P

from keyloom.llm import bpe, decontaminate, jaccard, langid, media, pseudonyms, secrets, tokencount


def test_null_ids(spark):
    text = "the same words here and some more of them to make a text, 10.0.0.1"
    rows = [(None, text, "en", 1), (None, text, "en", 1), (7, text, "en", 1), (8, "other", None, None), (None, "alone with another text altogether", "en", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    items = spark.createDataFrame([(1, text), (None, text)], "item_id long, text string")
    for out in (
        media.read_media(media.encode_media(docs)), langid.predict(docs, langid.fit(docs)), pseudonyms.mask(docs, "k"), secrets.find(docs), secrets.redact(docs),
        bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tokencount.token_counts(docs, P.path("piece_bpe_32k.model")), jaccard.link(docs),
    ):
        got = [r.doc_id for r in out.collect()]
        assert sorted(map(str, got)) == sorted(str(r[0]) for r in rows), out.columns
    assert sorted(str(r.doc_id) for r in decontaminate.matches(docs, items).collect()) == ["7", "None", "None"]
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.link(docs).collect()}
    assert found[None, 12] == 7 and found[7, 12] == 7 and found[None, 3] is None and found[None, 0] is None
    kept = sorted((str(r.doc_id), str(r.text)[:5]) for r in jaccard.keep_one(docs).collect())
    assert kept == [("7", "the s"), ("8", "other"), ("None", "None"), ("None", "alone")]


def test_one_row_of_each_group_stays(spark):
    """Copies without ids, ids that repeat with one text and with several, and near copies among them."""
    base = " ".join(f"w{i}" for i in range(60))
    near, alone, other = base + " end", "a text that is alone", "a text of two rows without ids"
    rows = [
        (5, base, "a"), (5, base, "b"), (5, base, "b"), (6, near, "c"), (None, base, "d"), (None, near, "e"), (5, alone, "f"), (None, other, "g"), (None, other, "h"),
        (9, "own words of nine", "i"), (9, "own words of nine", "i"), (None, "", "j"), (None, None, "k"), (3, " ", "l"), (3, " ", "l"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cut in (docs, docs.repartition(5), docs.orderBy("source")):
        got = sorted((str(r.doc_id), str(r.text), r.source) for r in jaccard.keep_one(cut).collect())
        texts = sorted((i, t) for i, t, _ in got if t.strip() and t != "None")
        # base and alone share the id 5 and so are one component: one of them stays
        assert len(texts) == 3 and ("9", "own words of nine") in texts and ("None", other) in texts and sum(i == "5" for i, _ in texts) == 1
        assert [x for x in got if x[2] in "jkl"] == [("3", " ", "l"), ("3", " ", "l"), ("None", "", "j"), ("None", "None", "k")]
        assert cut is docs or got == first
        first = got
