"""Media columns: lossless 8-bit PNG in a binary column, read back with checksum tests, and a low-frequency cosine hash.

``to_media`` turns a text (UTF-8, zero bytes appended up to a positive multiple of the row width) into a grey PNG of
that width; each row takes the filter (none, left or above) with the least sum of absolute differences. ``read_media``
parses the stored bytes chunk by chunk, tests each chunk's checksum, inflates the data chunks as one stream, undoes the
row filters in numpy, all five kinds, and hashes the low frequencies of a 32 x 32 area mean.

Defined results: a null or empty text gives one row of zeros; equal texts give equal bytes and hashes; a broken stored
value (bad signature, checksum, size or filter) raises ValueError, a null one gives nulls. Any length works: an image
has as many rows as it needs, and nothing is cut. A row whose filters tie takes the first of none, left and above; repeated rows give repeated results; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from neighborflow.llm.common import id_text

WIDTH, LEVEL, CHUNK = 64, 2, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
_k = np.arange(LOW)[:, None]
#: The first LOW rows of the type-2 cosine transform of length SIDE.
COSINES = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * _k / (2 * SIDE)) * np.where(_k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, dct_hash binary"


def payload(text: str, width: int = WIDTH) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // width)) * width, b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows as differences from a predictor: 0 none, 1 left, 2 above, 3 mean of both, 4 Paeth's."""
    x = rows.astype(np.int16)
    left = np.zeros_like(x)
    left[:, 1:] = x[:, :-1]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    if kind == 0:
        guess = 0
    elif kind == 1:
        guess = left
    elif kind == 2:
        guess = up
    elif kind == 3:
        guess = (left + up) >> 1
    else:
        corner = np.zeros_like(x)
        corner[1:, 1:] = x[:-1, :-1]
        guess = _paeth(left, up, corner)
    return ((x - guess) & 255).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def png(body: bytes, width: int = WIDTH, filters: np.ndarray | None = None) -> bytes:
    """Grey 8-bit PNG of whole rows. filters: a filter type for each row; by default the one of none, left and above
    whose differences, as signed bytes, sum up to the least."""
    rows = np.frombuffer(body, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    if filters is None:
        made = np.stack([rows, np.diff(rows, axis=1, prepend=np.uint8(0)), np.diff(rows, axis=0, prepend=np.zeros((1, width), np.uint8))])
        best = np.abs(made.view(np.int8).astype(np.int16)).sum(2).argmin(0)
        lines[:, 0], lines[:, 1:] = best, made[best, np.arange(len(rows))]
    else:
        lines[:, 0] = filters
        for kind in np.unique(filters):
            lines[filters == kind, 1:] = _filtered(rows, kind)[filters == kind]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    present = set(np.unique(kinds).tolist())
    if present <= {0, 1, 2}:
        # Left rows are running sums of their own; rows from above add up from the last row of another kind.
        rows = lines.copy()
        if 1 in present:
            rows[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
        if 2 in present:
            total = np.cumsum(rows, axis=0, dtype=np.uint8)
            base = np.maximum.accumulate(np.where(kinds != 2, np.arange(len(kinds)), -1))
            before = np.where((base > 0)[:, None], total[np.maximum(base - 1, 0)], 0)
            rows = total - before
        return rows
    # A pixel needs its left, upper and upper-left ones, so all pixels on one anti-diagonal can be restored at once.
    h, w = lines.shape
    out = np.zeros((h + 1, w + 1), np.int16)
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - r
        a, b, c, kind = out[r + 1, x], out[r, x + 1], out[r, x], kinds[r]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, _paeth(a, b, c)], 0)
        out[r + 1, x + 1] = (lines[r, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unpng(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, with every chunk's checksum tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(data[at + 4 : at + 8 + n]) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a complete grey 8-bit PNG")
    inflate = zlib.decompressobj()
    raw = b"".join([*(inflate.decompress(p) for p in parts), inflate.flush()])
    w, h = size[:2]
    if not inflate.eof or len(raw) != h * (w + 1):
        raise ValueError("the data chunks do not fill the image")
    lines = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _mean(x: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis]
    if n < SIDE:
        return np.take(x, np.arange(SIDE) * n // SIDE, axis)
    cuts = np.arange(SIDE) * n // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(x, cuts, axis) / np.diff(np.append(cuts, n)).reshape(shape)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the area mean exceed their median."""
    low = COSINES @ _mean(_mean(image.astype(np.float64), 0), 1) @ COSINES.T
    bits = low.ravel() > np.median(low.ravel()[1:]) + 1e-9
    return np.packbits(bits).tobytes()


def to_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes (before padding), media (the PNG)."""

    def encode(batches):
        for pdf in filter(len, batches):
            made = [payload(x, width) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for n, _ in made], "media": [png(b, width) for _, b in made]})

    return id_text(docs).mapInPandas(encode, MEDIA_SCHEMA)


def read_media(media: DataFrame) -> DataFrame:
    """Features of stored PNGs: digests of what was read back and of the stored form, and the hash as hex and binary."""

    def one(data: bytes) -> tuple:
        image = unpng(data)
        back, bits = image.tobytes(), cosine_hash(image)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), bits.hex(), bits

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "dct_hash"]

    def decode(batches):
        for pdf in filter(len, batches):
            rows = [one(x) if x is not None else (None,) * len(names) for x in pdf["media"]]
            out = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[["doc_id", "n_bytes"]], out], axis=1)

    return media.select("doc_id", "n_bytes", "media").mapInPandas(decode, FEATURE_SCHEMA)
