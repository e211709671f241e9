"""Media columns, byte-level BPE and token counts, against plain code."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from keyloom.llm import bpe, media, tokencount

ALPHABET = "ab1 2\n'sletvdm.,!é中  \t x9\x1c\x85▁<s>/"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(n, length, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_media(request, name):
    docs = request.getfixturevalue(name)
    got = sorted(map(tuple, media.digests(media.read_media(media.encode_media(docs))).collect()))
    want = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    assert len(got) == len(want)
    seen = {}
    for (i, n, size, sha, tail, m, m_sha, feature), (j, data) in zip(got, want):
        payload = media.pad(data)
        assert (i, n, size) == (j, len(data), len(payload)) and size % 64 == 0 and size
        assert sha == hashlib.sha256(payload).hexdigest() and tail == zlib.crc32(payload[-64:])
        assert seen.setdefault(data, (m, m_sha, feature)) == (m, m_sha, feature) and len(feature) == 16


def test_png_filters_and_damage():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (9, 64), np.uint8)
    lines = []
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 1, 3, 2]):
        out = [kind]
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines.append(bytes(out))
    body = zlib.compress(b"".join(lines))
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 9, 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", body[:50]) + media._chunk(b"IDAT", body[50:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == image).all()
    for at in (3, 20, 60, len(data) - 30, len(data) - 2):
        with pytest.raises(ValueError):
            media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(data[:-12])


def test_cosine_hash_is_the_transform():
    image = np.random.default_rng(2).integers(0, 256, (40, 64), np.uint8)
    low = [sum(image[y, x] * np.cos(np.pi * u * (2 * y + 1) / 80) * np.cos(np.pi * v * (2 * x + 1) / 128) for y in range(40) for x in range(64)) for u in range(8) for v in range(8)]
    assert media.cosine_hash(image) == np.packbits(np.array(low) > np.median(low[1:])).tobytes()


@pytest.mark.parametrize("leaf", [1, 2, 7, 33])
def test_bpe_tree_equals_library(leaf):
    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    for text in [*words(300, 200, leaf), "a" * 999, " " * 500 + "x", "x's 'll" * 50, "中文" * 300, "9a" * 200]:
        ids = codec.encode(text, leaf).tolist()
        assert ids == codec.enc.encode_ordinary(text)
        assert codec.decode(ids, 3) == text.encode()


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_bpe_query(request, name):
    docs = request.getfixturevalue(name)
    got = sorted(map(tuple, bpe.digests(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)).collect()))
    enc, want = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN).enc, []
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert sorted(map(tuple, bpe.digests(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)).collect())) == got


def test_pre_tokens_add_up(monkeypatch):
    counter = tokencount.Counter(open(MODEL, "rb").read())
    monkeypatch.setattr(tokencount, "CACHE", 50)
    for text in [*words(2000, 60, 5), "", " ", "  ", "\n", " \n", "\n ", "a\n", "</s>", "▁"]:
        assert counter.count(text) == len(counter.sp.encode(text)), text
    assert len(counter) <= 51


@pytest.mark.parametrize("name", ["odd", "empty", "documents"])
def test_token_counts(request, name):
    docs = request.getfixturevalue(name)
    sp, want = sentencepiece.SentencePieceProcessor(model_file=MODEL), []
    for r in docs.select("doc_id", "text").collect():
        n = len(sp.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, tokencount.token_counts(docs, MODEL).collect())) == sorted(want)
