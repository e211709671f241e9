"""Language identification by compression: the language whose dictionary makes a text smallest.

fit() takes a bounded sample of labelled rows (per_language rows of each language, sample_bytes
from the middle of each, least by a hash of the id) as raw-content dictionaries. predict() lowers
the whole text, makes each run of other characters than letters a blank, cuts the rest into pieces
of PIECE_BYTES, compresses each with every dictionary and adds up: pieces keep a long text from
becoming its own dictionary. To the sum comes the length of the language's own code word, by its
share of the labelled rows, as in any two-part code; it decides where texts are too short to tell. The
language of the least sum is the answer. The margin, by what share of the best's size the next is larger,
leaves the code words out (0 where they alone decide). Below min_margin the row is marked as rejected:
foreign and random texts fit all dictionaries about alike.

The code words were kept, and a bound on each piece's size left out, by learnable rows alone: with
dictionaries of the rows whose crc32(doc_id) mod 4 is 0 or 1, of 2,501 rows of mod 3 (sf0.1) 7 are wrong
with code words and 17 without, with or without a bound, with pieces of 256, 512 or 1,024 bytes.

A null text, or one without a letter, is `und` with score 0, and rejected. With one language or
none learned, the margin is 0 (with none, every row is `und`). Ties go to the name that sorts
first. Repeated rows stay, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, map_rows

PER_LANGUAGE, SAMPLE_BYTES, PIECE_BYTES = 64, 1024, 512
#: Lazy matching with fixed tables: a preset level would choose other ones for each dictionary's size.
ZSTD = {"window_log": 20, "hash_log": 17, "chain_log": 17, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}
#: Below this share of the smaller size, a margin is narrow: about a fifth of the median margin of learned rows that no dictionary holds (that is 0.048 to 0.062 on four of the tables). Scores saturate over STEEP.
MIN_MARGIN, STEEP = 0.05, 25.0
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, tuple[bytes, float]]:
    """By lang: raw content of at most per_language * sample_bytes, and its share of the labelled rows. Learns from rows that held_out() leaves alone."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in docs.select("doc_id", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a hash below the language's share leaves about four times the rows that are kept, however many there are
    share = F.coalesce(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * per_language / n))))[F.col("lang")], F.lit(0.0))
    mark = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    near = rows.filter(F.pmod(mark, F.lit(1 << 30)) < share * (1 << 30)).withColumn("mark", mark)
    order = Window.partitionBy("lang").orderBy("mark", "doc_id", "text")
    size, at = F.length("text"), F.greatest(F.lit(0), F.floor((F.length("text") - sample_bytes) / 2)).cast("int")
    kept = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).select("lang", "rank", F.substring(F.col("text"), at + 1, F.least(size, F.lit(sample_bytes))).alias("piece"))
    content: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], -r["rank"])):
        content[r["lang"]].append(letters(r["piece"])[:sample_bytes])
    return {lang: (b" ".join(x), counts[lang] / sum(counts.values())) for lang, x in content.items() if any(x)}


class Classifier:
    def __init__(self, dictionaries: dict[str, tuple[bytes, float]], piece_bytes: int = PIECE_BYTES):
        self.piece = piece_bytes
        self.by_lang = []
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **ZSTD)
        for lang, (content, share) in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_lang.append((lang, -math.log2(share) / 8, zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress))

    def sizes(self, text: str) -> list[tuple[float, str]]:
        data = letters(text)
        totals = [label for _, label, _ in self.by_lang]
        for i in range(0, len(data), self.piece):
            piece = data[i : i + self.piece]
            for k, (_, _, shrink) in enumerate(self.by_lang):
                totals[k] += len(shrink(piece))
        return [(total, lang) for total, (lang, _, _) in zip(totals, self.by_lang)]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language, and by what share of its size the next is larger, without the code words."""
        if text is None or not self.by_lang or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        _, lang = min(sizes)
        bare = {x: total - label for (total, x), (_, label, _) in zip(sizes, self.by_lang)}
        best = bare.pop(lang)
        return lang, max(0.0, min(bare.values()) - best) / best if bare else 0.0


def predict(docs: DataFrame, dictionaries: dict[str, tuple[bytes, float]], min_margin: float = MIN_MARGIN, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1, rises with the margin), margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bytes: languages * PER_LANGUAGE * SAMPLE_BYTES

    def make():
        classify = Classifier(shared.value, piece_bytes)

        def step(rows):
            found = [classify(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang_pred": [x for x, _ in found], "score": [1 - math.exp(-STEEP * m) for _, m in found], "margin": [m for _, m in found], "rejected": [x == UNKNOWN or m < min_margin for x, m in found]}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, lang_pred string, score double, margin double, rejected boolean", make)


def keep_identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay. The texts are judged where they lie: no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        classify = Classifier(shared.value)

        def step(rows):
            found = [classify(t) for t in rows["text"]]
            keep = [i for i, (lang, m) in enumerate(found) if lang != UNKNOWN and m >= min_margin]
            return {k: [v[i] for i in keep] for k, v in rows.items()}

        return step

    return map_rows(docs, ddl(docs), make)
