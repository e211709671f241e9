"""Token counts of a sentencepiece BPE model, by pre-tokens and two tiers of known lengths.

No piece of the model has its space mark behind another character, and none holds a line end, so
merges never cross a boundary before spaces or at a line end (Counter checks this of its model,
and that it neither drops spaces nor rewrites characters). A text's count is then the sum over
its pre-tokens. frequent() counts the pre-tokens of a bounded sample and broadcasts the lengths
of the commonest: it changes the speed and never a count. What the table lacks, a worker encodes
once and remembers in a cache of bounded size. Pre-tokens are never shuffled.

Null counts as empty (0 tokens); any white space, control strings such as `</s>` and the model's
own space mark are ordinary text, as the library treats them. Repeated rows stay, extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter as Tally

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

LIMIT = 4096
#: Rows sampled for the table; entries of the table; entries and key length of a worker's cache.
SAMPLE_ROWS, TABLE, CACHE, LONGEST = 2000, 1 << 15, 1 << 17, 64
MARK = "▁"
PRE_TOKENS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKENS.findall(" " + text.replace(MARK, " ")) if text else []


class Counter(dict):
    """Lengths by pre-token: the broadcast table, then the worker's cache, then the encoder."""

    def __init__(self, model: bytes, table: dict[str, int] | None = None):
        super().__init__(table or {})
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.first, self.get_length = len(self), self.__getitem__
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        probe = self.sp.encode(" a  b ", out_type=str)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) or "".join(probe) != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model's merges can cross pre-tokens")

    def length(self, key: str) -> int:
        """Tokens of one pre-token; the encoder puts a space mark before what it is given."""
        if key == " ":
            return 1
        return len(self.sp.encode(key[1:])) if key[0] == " " else len(self.sp.encode(key)) - 1

    def __missing__(self, key: str) -> int:
        n = self.length(key)
        if len(key) <= LONGEST:
            if len(self) >= self.first + CACHE:
                for old in list(self)[self.first :]:
                    del self[old]
            self[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.get_length, pre_tokens(text)))


def frequent(docs: DataFrame, model: bytes, rows: int = SAMPLE_ROWS, size: int = TABLE) -> dict[str, int]:
    """Lengths of the commonest pre-tokens in a sample of at most `rows` texts, least by a hash of the id."""
    n = docs.count()
    share = min(1.0, 2 * rows / max(n, 1))
    mark = F.pmod(F.xxhash64(F.lit("tokens"), F.col("doc_id")), F.lit(1 << 30))
    sample = texts(docs.filter(mark < F.lit(share * (1 << 30)))).select(F.substring("text", 1, 4000).alias("text")).limit(rows)
    seen = Tally(x for r in sample.toLocalIterator() for x in pre_tokens(r["text"]) if len(x) <= LONGEST)
    counter = Counter(model)
    return {k: counter.length(k) for k, c in seen.most_common(size) if c > 1}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). The driver reads the model; its bytes are broadcast."""
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent(docs, model)))

    def make():
        counter = Counter(*shared.value)

        def step(rows):
            found = [counter.count(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]], "n_tokens": found, "over_limit": [n > limit for n in found]}

        return step

    return map_rows(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
