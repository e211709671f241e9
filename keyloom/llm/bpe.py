"""Byte-level BPE encoding as a reduction over a tree of halves.

encode() halves a text until parts are short, encodes those and joins neighbours. A cut is safe
where a printable ASCII character stands before a blank or line end, or where ASCII letters meet
digits: no match of the splitting pattern spans it, whatever surrounds it, so tokens on both
sides of it are final. A join looks for the nearest safe cut on each side of its seam in windows
that double, re-encodes what lies between, and keeps all tokens outside, which are thus proved
stable. The joining operation is associative: any tree gives the tokens of the whole text.
decode() concatenates the bytes of halves of the ids up the same kind of tree.

Null counts as empty: no tokens. Special strings are ordinary text. Repeated rows stay, extra
columns are ignored, an empty table gives an empty result. Ids outside the vocabulary raise
KeyError in decode().
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

LEAF, WINDOW = 2048, 32
_SAFE = re.compile(r"(?<=[!-~])[ \n]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.lru_cache(2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values(), default=0) + 1, np.int64)
        for word, rank in table.items():
            self.size[rank] = len(word)

    def leaf(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return np.concatenate([*self._node(text, 0, len(text), leaf), np.empty(0, np.uint32)])

    def _node(self, text: str, a: int, b: int, leaf: int) -> list[np.ndarray]:
        """Tokens of text[a:b], as a list of parts."""
        if b - a <= leaf:
            return [self.leaf(text[a:b])]
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._node(text, a, mid, leaf), self._node(text, mid, b, leaf))

    def _join(self, text: str, a: int, mid: int, b: int, left: list, right: list) -> list:
        if _SAFE.match(text, mid):
            return left + right
        lo, hi, reach = a, b, WINDOW
        while mid - reach > a:
            # the character before a cut and the one after it both lie in this half
            if cuts := [m.start() for m in _SAFE.finditer(text, mid - reach, mid)]:
                if (last := max((c for c in cuts if c > a), default=0)):
                    lo = last
                    break
            reach *= 2
        reach = WINDOW
        while mid + reach < b:
            if m := _SAFE.search(text, mid + 1, mid + reach):
                hi = m.start()
                break
            reach *= 2
        return self._drop(left, len(text[lo:mid].encode()), True) + [self.leaf(text[lo:hi])] + self._drop(right, len(text[mid:hi].encode()), False)

    def _drop(self, parts: list, n: int, tail: bool) -> list:
        """parts without the tokens of n bytes at one end; these end at a token's edge, as the cut is safe."""
        parts = list(parts)
        while n and parts:
            part = parts.pop(-1 if tail else 0)
            sizes = self.size[part]
            if (total := int(sizes.sum())) <= n:
                n -= total
                continue
            ends = np.cumsum(sizes[::-1] if tail else sizes)
            k = int(np.searchsorted(ends, n)) + 1
            if ends[k - 1] != n:
                raise AssertionError("a cut inside a token")
            parts.insert(len(parts) if tail else 0, part[:-k] if tail else part[k:])
            n = 0
        return parts

    def decode(self, ids, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers in a binary column). The driver reads the ranks and broadcasts them."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def make():
        own = codec(*shared.value)

        def step(rows):
            ids = [own.encode(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids]}

        return step

    return map_rows(texts(docs), "doc_id long, n_tokens long, ids binary", make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode()'s columns and decoded, the bytes of the ids (null for null)."""
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def make():
        own = codec(*shared.value)

        def step(rows):
            return rows | {"decoded": [None if x is None else own.decode(np.frombuffer(x, "<u4").tolist()) for x in rows["ids"]]}

        return step

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), "doc_id long, n_tokens long, ids binary, decoded binary", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode() and decode() in one pass of one worker a task, which spares sending the ids to and fro."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def make():
        own = codec(*shared.value)

        def step(rows):
            ids = [own.encode(t).astype("<u4").tobytes() for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [own.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]}

        return step

    return map_rows(texts(docs), "doc_id long, n_tokens long, ids binary, decoded binary", make)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
