"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and freed of signs at their ends. A mask counts some places of a stretch of words and ignores the
others, so a substituted word at one of these leaves the hash as it is. The hashes of the benchmark's words under each
mask are held against those of every place of every document; at each hit the item's windows of `WINDOW` words that have
it are laid on the document, and the best one counts: a document is contaminated if at least `IDENTITY` of such a window
agrees with some item. Items shorter than the window count as a whole.

The masks leave no substitutions out that the threshold allows. A window (or shorter item) in which k words may differ
is cut into k + 2 parts; two parts are then untouched, and each two parts are a mask (of 15 words, with 3 changed: two of
five parts of three words). Masks that are equal but for where they begin are hashed once.

Benchmarks are small beside the corpus, but may grow: they are taken in blocks of at most about `BLOCK_WORDS` words,
whose seeds are broadcast, and the documents are searched for one block after the other. Documents without a hit never
leave their partition, those of a benchmark of one block never do, so a passage that a third of them hold makes no hot key.

Defined results: a null text is empty; null items and items without words are not searched; several items that overlap
equally: the least item id; a very long text is searched whole, also one that repeats the words of an item; rows are kept
one by one, also with equal or null ids; an empty table gives no rows, an empty benchmark contaminates nothing; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, WordCache, fresh, numbered, sieve, slices, table, texts_of, written

#: Fixed values
WINDOW, IDENTITY = 15, 0.8
BLOCK_WORDS = 200_000
MOST_BITS = 24  # of the table that spares most windows the search
CACHE_MB = 40.0
PAIRS = 200_000  # of a place and a window that are compared at once
SHARES = math.lcm(*range(1, WINDOW + 1))  # shares of agreeing words, as whole numbers
UNKNOWN = np.int32(-1).tobytes()
NOTHING = -2  # fills windows of short items, agrees with no word
SIGNS = ".,;:!?*#$%&|()[]{}\"'<>«»“”"
RNG = np.random.default_rng(20)
FACTORS = RNG.integers(1, 2**63, WINDOW, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(SIGNS) for x in text.lower().split()) if w]


def seed_hashes(ids: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """A hash of each window's words at the places; ids are word numbers."""
    n = max(len(ids) - places[-1], 0)
    return mixed([ids[p : p + n] for p in places])


def mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A hash of each row of word numbers, given by columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x, f in zip(columns, FACTORS, strict=False):
            out += x.astype(np.uint64) * f
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def masks(n: int, identity: float = IDENTITY) -> list[tuple[int, ...]]:
    """Places within n words, so that any n words of which at least `identity` agree agree at all places of some mask."""
    changes = n - math.ceil(identity * n - 1e-9)
    parts = changes + 2
    if not changes or parts > n:
        return [tuple(range(n))] if not changes else [(k,) for k in range(n)]
    even = n // parts >= 3  # then equal parts, for fewer different masks
    cuts = [k * (n // parts) if even else k * n // parts for k in range(parts + 1)]
    return [(*range(cuts[i], cuts[i + 1]), *range(cuts[j], cuts[j + 1])) for i in range(parts) for j in range(i + 1, parts)]


class Overlap(NamedTuple):
    item: int
    agree: int
    window: int
    hits: int


class Seeds:
    """A block of the benchmark, ready to be searched for.

    What is searched for are the distinct windows of each item: one that an item repeats, as a run of one word does at
    every place, is kept once, so equal stretches do not multiply with one another.
    """

    def __init__(self, items: list[tuple[int, str]], identity: float = IDENTITY):
        self.identity = identity
        found = [(i, words_of(t or "")) for i, t in items if i is not None]
        found = sorted((i, w) for i, w in found if w)
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in found for x in w}))}  # 0: in no item
        self.vocabulary = vocabulary
        self.items = [i for i, _ in found]
        self.words = [np.array([vocabulary[x] for x in w], np.int32) for _, w in found]
        self.sizes = np.array([min(len(w), WINDOW) for w in self.words], np.int64)  # of the items' windows
        blocks = [np.zeros((0, WINDOW), np.int32)]
        for w, n in zip(self.words, self.sizes.tolist(), strict=True):
            every = np.lib.stride_tricks.sliding_window_view(w, n)
            every = np.unique(every, axis=0) if len(every) > 1 else every
            blocks.append(np.pad(every, ((0, 0), (0, WINDOW - n)), constant_values=NOTHING))
        self.windows = np.concatenate(blocks)
        self.item_of = np.repeat(np.arange(len(self.words)), [len(b) for b in blocks[1:]])
        # the places of a mask, from 0 on -> size of windows -> the places before the mask
        shapes: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for n in np.unique(self.sizes).tolist():
            for m in masks(n, identity):
                shapes.setdefault(tuple(p - m[0] for p in m), []).append((n, m[0]))
        of_size = {n: np.flatnonzero(self.sizes[self.item_of] == n) for n in np.unique(self.sizes).tolist()}
        self.sets = []
        for places, of in shapes.items():
            window = np.concatenate([of_size[n] for n, _ in of]).astype(np.int32)
            before = np.repeat(np.array([x for _, x in of], np.int8), [len(of_size[n]) for n, _ in of])
            hashes = np.concatenate([mixed(self.windows[of_size[n]][:, [x + p for p in places]].T) for n, x in of])
            order = np.argsort(hashes, kind="stable")
            bits = min(max(20, math.ceil(math.log2(256 * len(hashes) + 1))), MOST_BITS)  # one in 256 other windows passes, more in large blocks
            known = np.zeros(1 << bits, bool)
            known[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.sets.append((places, hashes[order], window[order], before[order], np.packbits(known, bitorder="little"), np.uint64(64 - bits)))
        packed = {w: np.int32(k).tobytes() for w, k in vocabulary.items()}
        # signs alone are no word and leave nothing
        self.cache = WordCache(lambda w: packed.get(x, UNKNOWN) if (x := w.strip(SIGNS)) else b"", CACHE_MB, value_bytes=40)

    def __reduce__(self):
        return _seeds, ([(i, " ".join(self._text(w))) for i, w in zip(self.items, self.words, strict=True)], self.identity)

    def _text(self, ids: np.ndarray) -> list[str]:
        if not hasattr(self, "_names"):
            self._names = {k: w for w, k in self.vocabulary.items()}
        return [self._names[k] for k in ids.tolist()]

    def search(self, texts: list[str]) -> list[Overlap | None]:
        """The best overlap of each text with a window that shares a seed with it. All texts are hashed as one row of
        words, parted by WINDOW unknown words, so that numpy works on long arrays."""
        out: list[Overlap | None] = [None] * len(texts)
        if not self.items:
            return out
        known_words = self.cache.__getitem__
        parts = [b"".join(map(known_words, t.lower().split())) for t in texts]
        sizes = np.array([len(p) // 4 for p in parts])
        starts = np.cumsum(sizes + WINDOW) - sizes
        ids = np.frombuffer(UNKNOWN * WINDOW + (UNKNOWN * WINDOW).join(parts) + UNKNOWN * WINDOW, np.int32)
        best, hits = np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64)
        around = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
        for places, hashes, window, before, known, shift in self.sets:
            h = seed_hashes(ids, places)
            at = h >> shift
            where = np.flatnonzero(known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            lo, hi = np.searchsorted(hashes, h[where], "left"), np.searchsorted(hashes, h[where], "right")
            where, lo, n = where[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(where):
                continue
            doc = np.searchsorted(starts, where, "right") - 1
            hits += np.bincount(doc, minlength=len(texts))
            ends = np.cumsum(n)
            for begin in range(0, int(ends[-1]), PAIRS):  # pairs of a place and a window, so many at once
                pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
                hit = np.searchsorted(ends, pair, "right")
                seed = lo[hit] + pair - (ends - n)[hit]
                k = window[seed]
                agree = (around[where[hit] - before[seed]] == self.windows[k]).sum(axis=1)
                item = self.item_of[k]
                # the largest share, then the first item
                np.maximum.at(best, doc[hit], agree * (SHARES // self.sizes[item]) * len(self.items) + len(self.items) - 1 - item)
        for i in np.flatnonzero(best >= 0).tolist():
            share, item = divmod(int(best[i]), len(self.items))
            item = len(self.items) - 1 - item
            n = int(self.sizes[item])
            out[i] = Overlap(self.items[item], share * n // SHARES, n, int(hits[i]))
        return out


def _seeds(items: list[tuple[int, str]], identity: float) -> Seeds:
    return Seeds(items, identity)


OVERLAP = "struct<item_id: bigint, agree: int, window: int, hits: bigint>"


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, identity: float = IDENTITY, into: str = "overlap") -> DataFrame:
    """The rows of docs with all their columns and a struct `into` of item_id, agree, window and hits of the best overlap
    with a window that shares a seed, or null; a column of docs with that name gives way.

    One block of the benchmark is streamed through. With more blocks, docs is read once for each, so it should be a table;
    row numbers and overlaps alone are written, and joined with the rows that a sieve lets pass.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sized = items.withColumn("n", F.size(F.split(F.trim("text"), r"\s+")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    docs = docs.drop(into)
    if blocks == 1:
        out = docs.select("*", F.lit(None).cast(OVERLAP).alias(into))
        return _searched(out, text, Seeds([(r.id, r.text) for r in items.collect()], identity))  # about block_words words
    rows, row = numbered(docs, written)
    plain = rows.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"), F.lit(None).cast(OVERLAP).alias("o"))
    with Scratch(spark) as keep:
        got = []
        for k in range(blocks):
            part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
            one = _searched(plain, "text", Seeds([(r.id, r.text) for r in part.collect()], identity))
            got.append(keep(one.where("o IS NOT NULL").select("row", "o.*"), "seeds-block"))
        every = functools.reduce(DataFrame.unionByName, got)
        # the largest share, then the least item
        order = F.struct((F.col("agree") * F.lit(SHARES) / F.col("window")).cast("long"), F.bitwise_not("item_id"), "window")
        best = every.groupBy("row").agg(F.max_by(F.struct("item_id", "agree", "window"), order).alias("b"), F.sum("hits").alias("hits"))
        found = written(best.select("row", F.struct("b.item_id", "b.agree", "b.window", "hits").cast(OVERLAP).alias("o")), "seeds-found").toDF(fresh("row", [*docs.columns, into]), into)
    at = found.columns[0]
    maybe = sieve(found.select(at))(F.col(row))
    rest = rows.where(~maybe).select(*docs.columns, F.lit(None).cast(OVERLAP).alias(into))
    return rest.union(rows.where(maybe).join(found, F.col(row) == F.col(at), "left").select(*docs.columns, into))


def _searched(rows: DataFrame, text: str, seeds: Seeds) -> DataFrame:
    """rows with the best overlap of each in their last column."""
    shared = rows.sparkSession.sparkContext.broadcast(seeds)
    schema, names = rows.schema, rows.columns
    kind = to_arrow_type(schema[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, 2_000_000, text, shared.value.cache):
            got = pa.array([x and dict(zip(("item_id", "agree", "window", "hits"), x, strict=True)) for x in shared.value.search(texts_of(b, text))], kind)
            shared.value.cache.turn()
            yield pa.record_batch([*b.columns[:-1], got], names=names)

    return rows.mapInArrow(run, schema)


def is_contaminated(found: Column, identity: float = IDENTITY) -> Column:
    return F.coalesce(found["agree"] >= F.lit(identity) * found["window"], F.lit(False))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("overlap")
    bad = is_contaminated(found)
    keep = lambda c: F.when(bad, found[c]).alias(c)
    return overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", bad.alias("contaminated"), keep("item_id"), keep("agree"), keep("window"), F.coalesce(found["hits"], F.lit(0)).cast("long").alias("seed_hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, identity: float = IDENTITY) -> DataFrame:
    """The rows of docs, with all their columns, that share no passage with the benchmark."""
    into = fresh("overlap", docs.columns)
    return overlaps(docs, benchmark, identity=identity, into=into).where(~is_contaminated(F.col(into), identity)).select(*docs.columns)
