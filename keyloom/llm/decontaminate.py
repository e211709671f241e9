"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters (after normalise()) occurs in a text if some substring of the text is
within k = floor(rate * m) edits of it. Cut into k + 1 pieces, one piece must then occur exactly:
an Aho-Corasick automaton over all pieces finds these hits in one pass over the text, and Myers'
bit-parallel distance verifies the stretch around each. The same holds for items of any length: short
ones have a budget of 0, so they must occur as they are, and then at word edges ("cat" isn't in
"category"; between characters of scripts without blanks every place is an edge). An item of a word
or two occurs in many clean texts: min_chars (0) leaves out items with fewer characters altogether.

The benchmark is taken in blocks of at most about block_bytes, each collected and broadcast on its own,
so what the driver and a worker hold doesn't grow with the benchmark; each block is one pass over the documents.

Null and empty texts and items match nothing. Repeated documents give repeated rows, repeated item
ids one row each (with equal texts equal rows); extra columns are ignored by matches() and kept by
clean(). An empty table on either side gives no matches.
"""

from __future__ import annotations

import functools
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_rows, texts

RATE, MIN_CHARS, BLOCK_BYTES = 0.07, 0, 4 << 20
#: Letters of scripts that put no blanks between words (Thai to Burmese, kana, Han and Hangul, whose words take endings).
_JOINED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_BLANK = bytes(32 if chr(i) in string.punctuation or i < 33 or i == 127 else i for i in range(256))


def normalise(text: str | None) -> str:
    """Lower case; each run of ASCII punctuation and white space is one blank, none at the ends."""
    return b" ".join((text or "").lower().encode().translate(_BLANK).split()).decode()


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 even parts of range(m)."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of length m to a substring of text, and where the first such ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for at, char in enumerate(text, 1):
        eq = get(char, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, at
        up <<= 1
        plus = (down << 1 | ~(vertical | up)) & full
        minus = up & vertical
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        out[char] |= 1 << i
    return dict(out)


def at_edges(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither starts nor ends inside a word."""

    def edge(i: int) -> bool:
        return not 0 < i < len(text) or not (text[i - 1].isalnum() and text[i].isalnum()) or bool(_JOINED.match(text[i - 1]) or _JOINED.match(text[i]))

    return edge(a) and edge(b)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.items, found = [], defaultdict(list)
        for item_id, text in items:
            text = normalise(text)
            if len(text) >= max(min_chars, 1):
                k = int(rate * len(text))
                for a, b in pieces(len(text), k):
                    found[text[a:b]].append((len(self.items), a))
                self.items.append((item_id, text, k, masks(text), masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end in the normalised text) of the best match of each item."""
        text = normalise(text)
        out, diagonals = [], defaultdict(set)
        if self.any and text:
            for last, (size, where) in self.automaton.iter(text):
                for item, offset in where:
                    diagonals[item].add(last + 1 - size - offset)
        for item, starts in diagonals.items():
            item_id, pattern, k, forward, backward = self.items[item]
            m, best = len(pattern), None
            if not k:  # the one piece is the item
                first = min((s for s in starts if at_edges(text, s, s + m)), default=None)
                if first is not None:
                    out.append((item_id, 0, first, first + m))
                continue
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + m + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                elif b - a >= m - k:
                    spans.append([a, b])
            for a, b in spans:
                distance, end = myers(forward, m, text[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    head = text[max(a, a + end - m - k) : a + end]
                    best = (distance, a + end - myers(backward, m, head[::-1])[1], a + end)
            if best:
                out.append((item_id, *best))
        return out


@functools.lru_cache(4)
def _matcher(items: tuple, rate: float, min_chars: int) -> Matcher:
    return Matcher(list(items), rate, min_chars)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """The items, in parts of about block_bytes by a hash of the id, one at a time; each part is a tuple (item_id, text)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("item_id").isNotNull() & (F.length("text") > 0))
    total = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(n, 1)))
    for i in range(n):
        yield tuple(sorted((r["item_id"], r["text"]) for r in rows.filter(part == i).collect()))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: for each document and item that occurs in it, the best place."""
    schema = "doc_id long, item_id long, distance long, match_start long, match_end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            match = _matcher(shared.value, rate, min_chars)

            def step(rows):
                found = [(i, *x) for i, t in zip(rows["doc_id"], rows["text"]) for x in match(t)]
                return dict(zip(("doc_id", "item_id", "distance", "match_start", "match_end"), zip(*found) if found else [()] * 5))

            return step

        out = out.union(map_rows(texts(docs), schema, make))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in which an item occurs; judged where they lie, one pass a block."""
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            match = _matcher(shared.value, rate, min_chars)

            def step(rows):
                keep = [i for i, t in enumerate(rows["text"]) if not match(t)]
                return {k: [v[i] for i in keep] for k, v in rows.items()}

            return step

        docs = map_rows(docs, ddl(docs), make)
    return docs
