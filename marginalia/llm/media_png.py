"""Media columns: texts as 8-bit grey PNG images in binary columns, and perceptual hashes of what is read back.

Writing packs the bytes 64 to a row, filters rows, deflates and wraps the PNG chunks with their checksums. Reading walks
the chunks, tests every checksum, inflates the data and undoes the row filters with numpy. The feature is a hash of the
low frequencies of a cosine transform: the image is averaged to 32 x 32, and of its 8 x 8 lowest coefficients each bit
says whether one is above their median.

Defined results: a null text is empty and is one row of zero bytes; rows are kept one by one, also with equal or null
ids; an empty table gives no rows; other columns are ignored; equal texts give equal values; a very long text is a tall
image, written and read by itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of, written

WIDTH, SIGNATURE = 64, b"\x89PNG\r\n\x1a\n"
LEVEL = 6
SIDE, LOW = 32, 8
STORE_SCHEMA = "doc_id long, n_bytes long, image binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str) -> tuple[int, bytes]:
    """The text's bytes, and those with zeros up to a positive multiple of WIDTH."""
    data = text.encode("utf-8", "replace")
    return len(data), data + bytes(-len(data) % WIDTH if data else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with their filter bytes: no filter, or per row left or upper differences if these vary less as a whole."""
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = np.stack([np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1) for x in (left, up)])
    best = np.where(cost[0] <= cost[1], 1, 2).astype(np.uint8)
    other = np.where(best[:, None] == 1, left, up)
    if _spread(other) < _spread(rows):
        return np.column_stack([best, other])
    return np.column_stack([np.zeros(len(rows), np.uint8), rows])


def _spread(x: np.ndarray) -> float:
    """Bits per byte by the bytes' own frequencies."""
    p = np.bincount(x.ravel(), minlength=256) / x.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def write_png(data: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(rows).tobytes(), level)) + chunk(b"IEND", b"")


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters of one-byte samples."""
    out = rows.copy()
    if not kinds.any():
        return out
    for y, kind in enumerate(kinds.tolist()):
        above = out[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            out[y] = np.cumsum(rows[y], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = rows[y] + above
        elif kind in (3, 4):
            line, a, c = rows[y].tolist(), 0, 0
            for x, (v, b) in enumerate(zip(line, above.tolist(), strict=True)):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[x] = a = (v + guess) & 255
                c = b
            out[y] = line
        elif kind:
            raise ValueError(f"unknown filter {kind}")
    return out


def read_png(file: bytes) -> np.ndarray:
    """The image's samples, a row each; raises ValueError on damage."""
    if file[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, head, ended = 8, [], None, False
    while at < len(file) and not ended:
        if at + 12 > len(file):
            raise ValueError("cut short")
        (size,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        body = file[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", file, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, width + 1)
    return unfiltered(raw[:, 0], raw[:, 1:])


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


COSINES = _cosines()


def _averages(n: int) -> np.ndarray:
    """SIDE x n: the share of each sample in each of SIDE equal stretches."""
    edges = np.linspace(0, n, SIDE + 1)
    at = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * (SIDE / n)


def _rows_averaged(image: np.ndarray) -> np.ndarray:
    """Rows averaged in SIDE equal stretches, by differences of running sums between stretch edges."""
    n = len(image)
    sums = np.vstack([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    edges = np.linspace(0, n, SIDE + 1)
    low = np.minimum(edges.astype(int), n - 1)
    part = sums[low] + (edges - low)[:, None] * image[low]
    return np.diff(part, axis=0) * (SIDE / n)


ACROSS = _averages(WIDTH).T


def feature(image: np.ndarray) -> str:
    """16 hex digits."""
    across = ACROSS if image.shape[1] == WIDTH else _averages(image.shape[1]).T
    low = (COSINES @ (_rows_averaged(image) @ across) @ COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and the image of every row, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            made = [payload(t) for t in texts_of(b)]
            yield pa.record_batch([b.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([write_png(x) for _, x in made], pa.binary())], names=["doc_id", "n_bytes", "image"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, STORE_SCHEMA), "media")


def features(stored: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, digests and the hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                cells: list[list] = [[] for _ in range(6)]
                for file in b.column("image").to_pylist():
                    image = read_png(file)
                    data = image.tobytes()
                    row = len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(file), hashlib.sha256(file).hexdigest(), feature(image)
                    for c, v in zip(cells, row, strict=True):
                        c.append(v)
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
                yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, FEATURE_SCHEMA)


def op8_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
