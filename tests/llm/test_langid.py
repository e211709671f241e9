import math
import random
import re
import zlib

import zstandard
from pyspark.sql import functions as F

from keyloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) / len(got) < 0.01


def test_the_answer_is_the_smallest_encoding(spark, documents):
    """By brute force: each piece compressed anew with each dictionary; ties go to the first name."""
    model = langid.fit(documents) | {"zz": langid.fit(documents)["en"]}  # en and zz tie
    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **langid.ZSTD)

    def size(text, lang):
        content, share = model[lang]
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        total = -math.log2(share) / 8
        for i in range(0, len(data), langid.PIECE_BYTES):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            total += len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(data[i : i + langid.PIECE_BYTES]))
        return total

    got = {r.doc_id: r for r in langid.predict(documents, model).collect()}
    for r in documents.collect():
        text = r.text or ""
        if not any(map(str.isalpha, text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = {lang: size(text, lang) for lang in model}
        assert got[r.doc_id].lang_pred == min(sorted(sizes), key=sizes.get)
        if got[r.doc_id].lang_pred == "en":
            assert got[r.doc_id].margin == 0 and got[r.doc_id].rejected


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(langid.held_out(F.col("doc_id")), F.lit("zz zz")).otherwise(F.col("text")))
    assert langid.fit(docs) == langid.fit(other)


def test_odd_rows(odd, empty, documents):
    model = langid.fit(documents)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 9, 11}
    assert all(r.rejected and r.score == 0 for i, r in got.items() if i in (1, 2, 9, 11))
    assert langid.predict(odd, model).count() == odd.count() and langid.predict(empty, model).collect() == []
    assert langid.fit(empty) == {} and {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    assert {r.margin for r in langid.predict(odd, {"en": model["en"]}).collect()} == {0.0}


def test_stage_keeps_columns(odd, empty):
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {1, 2, 9, 11} & {r.doc_id for r in kept.collect()}
    assert langid.keep_identified(empty).collect() == []


def test_foreign_and_random_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    foreign = [
        "x", "Сегодня утром в городе было очень холодно, но дети всё равно пошли гулять в парк.", "今天早上城里很冷，但是孩子们还是去公园散步了，大家都很高兴。",
        "Dzisiaj rano w mieście było bardzo zimno, ale dzieci i tak poszły na spacer do parku.", "Bu sabah şehirde hava çok soğuktu ama çocuklar yine de parka yürüyüşe gittiler.",
    ]
    texts = foreign + [" ".join([t] * 40) for t in foreign] + [word(n) for n in (40, 100, 300, 900) for _ in range(10)] + [" ".join(word(r.randint(2, 9)) for _ in range(n)) for n in (8, 30, 120) for _ in range(10)]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert sum(x.rejected for x in got) / len(got) > 0.97 and all(x.rejected for x in got if x.doc_id < 5)
    held = langid.predict(docs.filter(langid.held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 200 and sum(x.rejected for x in held if x.lang == x.lang_pred) / len(held) < 0.02
