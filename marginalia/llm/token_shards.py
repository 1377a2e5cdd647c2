"""Token-ID output: zstandard frames that are independent of one another, with a trailing seek table.

A shard is one file: data frames, then a skippable frame with the directory (per frame: first and last document, rows
and ids), then the seek table of the public zstd seekable format (compressed size, size and a 32-bit XXH64 of each
frame). A reader looks documents up in the directory and decompresses only the frames it needs, each checked.

Documents are range-partitioned and sorted by id, so shards follow one another in ascending id order. Ids take two
bytes where the vocabulary allows it, else four.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with equal ids stay, in the
order of their texts' hashes; an empty table gives no shards and no rows; other columns are ignored; a very long text is a frame of its own.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCache, slices, table, texts_of, written

SEEK_MAGIC, FOOTER_MAGIC, DIRECTORY_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50  # fixed values of the format
CHECKSUMS = 0x80
NULL_ID = -(2**63)
FRAME_IDS, SHARD_IDS = 65_536, 1_000_000
END_ID = 2
CACHE_MB = 240.0
TAIL = ".,;:!?*#$%&|)]\""
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, first_id long, last_id long, file binary"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Whole(Exception):
    """Such a text goes through the library in one piece."""


class ByteBpe:
    """Whole texts through the tokenizers library, chunk by chunk, as the bytes of little-endian ids.

    Its byte-level pattern never lets a piece run from a character that isn't white space into a following space, and
    a lone space belongs to what follows it. So a text may be cut before each lone space between two other characters
    and the ids of the chunks joined. Chunks are encoded once and kept; a text with any other shape of spaces, or with
    the text of an added token, goes through the library whole. So do all texts where the tokenizer's file names another
    normalizer, pattern or model, and the first text of each slice is held against the library in any case.
    """

    def __init__(self, path: str, cache_mb: float = CACHE_MB):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        split, model = about["pre_tokenizer"] or {}, about["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        self.by_chunks = (
            about["normalizer"] is None and about["post_processor"] is None and split.get("type") == "ByteLevel" and split.get("use_regex")
            and not split.get("add_prefix_space") and model["type"] == "BPE" and not any(model.get(x) for x in odd)
        )
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.vocabulary <= 65_536 else 4
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        # the characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in kept)
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.line_end = self.packed(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.after_space = WordCache(lambda w: self._chunk(w, " "), 0.8 * cache_mb, self, 60)
        self.at_start = WordCache(lambda w: self._chunk(w, ""), 0.2 * cache_mb, self, 60)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, word: str, space: str) -> bytes:
        """The ids of one chunk without its space."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise Whole
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # one piece of letters: no need for the pattern
            return array("H", [t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, (space + word).encode())))]).tobytes() if self.width == 2 else self.whole([space + word])[0]
        kept = self.after_space if space else self.at_start
        core = word.rstrip(TAIL)
        if len(core) < len(word) and core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # letters, then one piece of signs
            return kept[core] + self.at_start[word[len(core) :]]
        if "\n" in word:
            # a line end between two characters that aren't white space is a piece of its own
            lines = word.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self.line_end.join([kept[lines[0]], *map(self.at_start.__getitem__, lines[1:])])
        return self.whole([space + word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text."""
        if not self.by_chunks:
            return self.whole(texts)
        out: list[bytes] = []
        follow, begin = self.after_space.__getitem__, self.at_start
        for t in texts:
            try:
                if not t or any(x in t for x in self.added):
                    raise Whole
                words = iter(t.split(" "))
                out.append(begin[next(words)] + b"".join(map(follow, words)))
            except Whole:
                out.append(self.whole([t])[0] if t else b"")
        self.after_space.turn()
        self.at_start.turn()
        if out and out[0] != self.whole(texts[:1])[0]:
            raise ValueError("chunks and the tokenizers library disagree about a text")
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_mb: float = CACHE_MB) -> ByteBpe:
    """One per Python worker: the cache of chunks lives as long as the worker."""
    return ByteBpe(path, cache_mb)


def frame(rows: list[tuple[int, bytes]], width: int) -> bytes:
    """The number of rows, then document ids, lengths, and all ids, little-endian."""
    return struct.pack("<I", len(rows)) + np.array([d for d, _ in rows], "<i8").tobytes() + np.array([len(x) // width for _, x in rows], "<u8").tobytes() + b"".join(x for _, x in rows)


def unframe(data: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    (n,) = struct.unpack_from("<I", data)
    docs, sizes = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u8", n, 4 + 8 * n).astype(np.int64)
    ids = np.frombuffer(data, f"<u{width}", int(sizes.sum()), 4 + 16 * n)
    ends = np.cumsum(sizes)
    for d, s, e in zip(docs.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        yield d, ids[s:e]


def write_shard(frames: Iterable[list[tuple[int, bytes]]], width: int, level: int = 3) -> bytes:
    press = zstandard.ZstdCompressor(level=level, write_checksum=True)
    out, seek, directory = [], [], [struct.pack("<I", width)]
    for rows in frames:
        data = frame(rows, width)
        packed = press.compress(data)
        out.append(packed)
        seek.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        directory.append(struct.pack("<qqIQ", rows[0][0], rows[-1][0], len(rows), sum(len(x) for _, x in rows) // width))
    middle = b"".join(directory)
    table_ = b"".join(seek) + struct.pack("<IBI", len(seek), CHECKSUMS, FOOTER_MAGIC)
    return b"".join(out) + struct.pack("<II", DIRECTORY_MAGIC, len(middle)) + middle + struct.pack("<II", SEEK_MAGIC, len(table_)) + table_


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, file: bytes):
        n, flags, magic = struct.unpack("<IBI", file[-9:])
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        begin = len(file) - 9 - 12 * n
        if struct.unpack("<II", file[begin - 8 : begin]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("broken seek table")
        self.file, self.seek = file, np.frombuffer(file, "<u4", 3 * n, begin).reshape(n, 3).astype(np.int64)
        self.ends = np.cumsum(self.seek[:, 0])
        at = int(self.ends[-1]) if n else 0
        magic, size = struct.unpack("<II", file[at : at + 8])
        if magic != DIRECTORY_MAGIC or at + 8 + size != begin - 8:
            raise ValueError("broken directory")
        (self.width,) = struct.unpack_from("<I", file, at + 8)
        self.directory = list(struct.iter_unpack("<qqIQ", file[at + 12 : at + 8 + size]))
        self.opened = 0

    def read(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(document, ids) of frame k, checked against the seek table."""
        end, (packed, size, check) = int(self.ends[k]), (int(x) for x in self.seek[k])
        data = zstandard.ZstdDecompressor().decompress(self.file[end - packed : end], max_output_size=size)
        self.opened += 1
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return unframe(data, self.width)

    def documents(self, wanted: Iterable[int]) -> list[tuple[int, np.ndarray]]:
        """(document, ids) of the wanted documents, all of an id; only their frames are decompressed."""
        want, found = sorted(set(wanted)), []
        for k, (first, last, _, _) in enumerate(self.directory):
            if own := set(want[bisect_left(want, first) : bisect_right(want, last)]):
                found += [(d, x) for d, x in self.read(k) if d in own]
        return found


def write_shards(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = END_ID, frame_ids: int = FRAME_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards (part, seq, n_docs, n_ids, file) of docs in ascending order of doc_id, written in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the texts' hash parts rows of one id, or of none, if they are many
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        width, end = tokens.width, b"" if end_id is None else tokens.packed([end_id])
        frames, rows, in_frame, in_shard = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            file = write_shard(frames, width)
            ends = [None if x == NULL_ID else x for x in (frames[0][0][0], frames[-1][-1][0])]
            cells = [[part], [seq], [sum(map(len, frames))], [sum(len(x) for f in frames for _, x in f) // width], ends[:1], ends[1:], [file]]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["part", "seq", "n_docs", "n_ids", "first_id", "last_id", "file"])

        for b in slices(batches, 1000, owner=tokens):
            for d, ids in zip(b.column("doc_id").to_pylist(), tokens.encode(texts_of(b)), strict=True):
                ids = ids + end
                n = len(ids) // width
                if rows and n >= frame_ids:  # a very long text is a frame of its own
                    frames.append(rows)
                    rows, in_frame = [], 0
                rows.append((NULL_ID if d is None else d, ids))
                in_frame, in_shard = in_frame + n, in_shard + n
                if in_frame >= frame_ids:
                    frames.append(rows)
                    rows, in_frame = [], 0
                if in_shard >= shard_ids:
                    frames += [rows] if rows else []
                    rows, in_frame, in_shard = [], 0, 0
                    yield shard()
                    frames, seq = [], seq + 1
        frames += [rows] if rows else []
        if frames:
            yield shard()

    return written(rows.mapInArrow(run, SHARD_SCHEMA), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards.

    The ids before a shard are summed over the small columns alone: per partition, then within it. Only these sums are
    broadcast, a few bytes for each million ids; beyond 100,000 shards Spark chooses how to join.
    """
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = sums.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before_part"))  # a row for each partition
    own = shards.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("before_shard"))
    starts = written(own.join(before, "part").select("part", "seq", (F.col("before_part") + F.col("before_shard")).alias("before")), "token-starts")
    side = F.broadcast(starts) if starts.count() <= 100_000 else starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for before, file in zip(b.column("before").to_pylist(), b.column("file"), strict=True):
                shard = Shard(file.as_py())
                docs, starts, sizes, sums = [], [], [], []
                for k in range(len(shard.directory)):
                    for d, ids in shard.read(k):
                        docs.append(None if d == NULL_ID else d)
                        starts.append(before)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        before += len(ids)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "seq", "file").join(side, ["part", "seq"]).select("before", "file").mapInArrow(run, READ_SCHEMA)


def read_documents(shards: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """doc_id and ids of the wanted documents. Shards outside their range are not read, other frames not decompressed.
    wanted is a list that the caller bounds."""
    want = sorted(set(wanted))
    if not want:
        return shards.sparkSession.createDataFrame([], "doc_id long, ids array<int>")
    shared = shards.sparkSession.sparkContext.broadcast(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, file in zip(b.column("first_id").to_pylist(), b.column("last_id").to_pylist(), b.column("file"), strict=True):
                own = shared.value[bisect_left(shared.value, NULL_ID if first is None else first) : bisect_right(shared.value, last)]
                if own and (found := Shard(file.as_py()).documents(own)):
                    yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    near = shards.where((F.coalesce("first_id", F.lit(NULL_ID)) <= want[-1]) & (F.col("last_id") >= want[0]))
    return near.select("first_id", "last_id", "file").mapInArrow(run, "doc_id long, ids array<int>")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
