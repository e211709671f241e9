"""Media columns: 8-bit greyscale PNG files in binary columns, and perceptual hashes of them.

encode_media() stores each text's bytes as a PNG image; read_media() parses such files (from any
writer: greyscale, 8 bits, not interlaced, all five filters), tests every checksum, undoes the
filters with numpy and hashes the lowest frequencies of the image's cosine transform.

Nulls and empty texts become one row of zeros; equal texts give equal files, payloads and hashes;
repeated rows stay repeated; extra columns are ignored; an empty table gives an empty result.
A file that is null gives nulls; a damaged one raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 1
IDAT_BYTES = 1 << 16
#: Hash: this many frequencies each way; rows of the image taken at a time.
FREQUENCIES, BLOCK = 8, 4096


def pad(data: bytes, multiple: int = WIDTH) -> bytes:
    """data and zeros, to a positive multiple."""
    return data + bytes(-len(data) % multiple or (0 if data else multiple))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload, a positive multiple of width, as a greyscale PNG; one filter for the image, by least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [int(np.minimum(x, -x.astype(np.int16) & 255).sum()) for x in (rows, sub, up)]
    kind = cost.index(min(cost))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, (rows, sub, up)[kind]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    return b"".join([
        SIGNATURE,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)),
        *(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)),
        _chunk(b"IEND", b""),
    ])


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Rows without their filters; runs of rows with one of the first three filters at a time."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind = int(kinds[a])
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(int) if y else np.zeros(out.shape[1], int)
                left = corner = 0
                for x, raw in enumerate(out[y].tolist()):
                    top = int(above[x])
                    if kind == 3:
                        guess = (left + top) // 2
                    else:
                        base = left + top - corner
                        guess = min((left, top, corner), key=lambda v: abs(base - v))
                    left, corner = (raw + guess) & 255, top
                    out[y, x] = left
        elif kind:
            raise ValueError(f"unknown filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The image (height, width) of a greyscale PNG; ValueError where a checksum or the form is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def cosine_hash(image: np.ndarray, n: int = FREQUENCIES) -> bytes:
    """n*n bits: which of the n lowest frequencies each way of the 2-D cosine transform exceed their median (the mean's is left out of it)."""
    height, width = image.shape
    k = np.arange(n)[:, None]
    across = np.cos(np.pi * k * (2 * np.arange(width) + 1) / (2 * width))
    total = np.zeros((n, width))
    for a in range(0, height, BLOCK):
        rows = image[a : a + BLOCK].astype(np.float64)
        total += np.cos(np.pi * k * (2 * np.arange(a, a + len(rows)) + 1) / (2 * height)) @ rows
    low = (total @ across.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (PNG of the padded bytes)."""

    def make():
        def step(rows):
            data = [t.encode() for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(x) for x in data], "media": [encode_png(pad(x)) for x in data]}

        return step

    return map_rows(texts(docs), "doc_id long, n_bytes long, media binary", make)


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, and what the files hold: payload (samples by row), height, width, cosine_hash (binary)."""

    def make():
        def step(rows):
            images = [None if x is None else decode_png(x) for x in rows["media"]]
            return rows | {
                "payload": [None if x is None else x.tobytes() for x in images],
                "height": [None if x is None else x.shape[0] for x in images],
                "width": [None if x is None else x.shape[1] for x in images],
                "cosine_hash": [None if x is None else cosine_hash(x) for x in images],
            }

        return step

    return map_rows(media.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, media binary, payload binary, height long, width long, cosine_hash binary", make)


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of read_media()'s rows."""
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("cosine_hash")).alias("feature"),
    )
