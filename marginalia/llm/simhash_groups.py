"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits: a bit is set if over half of the XXH64 of its word shingles have it. Fingerprints
that differ in at most `radius` bits are linked, and linked ones form components.

Equal fingerprints are one node, so copies, however many, add nothing to what follows. Nodes are dealt to shards by
fixed parts of their bits: of four 16-bit parts a pair within two bits shares at least two, so each of the six pairs of
parts is a key, and linked nodes meet in a shard. Each shard grows a BK-tree (children keyed by the integer Hamming
distance to their parent) and follows only edges within the radius; it returns one link for each node that joins
another, never all pairs. A shard above `shard_nodes` is dealt anew by three parts of the bits that are still free, as
often as needed: a pair within the radius shares at least one of them, so no link is lost. The trees of one shard meet
its queries through the shuffle, not a broadcast, as all fingerprints together have no bound.

Components come from rounds of large-star and small-star steps, each written to the shared folder.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any other; one with
fewer words than a shingle is one shingle; rows are kept one by one, also with equal ids, and a null id never names a
component (a component of null ids only has a null name); an empty table gives no rows; other columns are ignored; a
very long text is hashed whole, some shingles at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, slices, table, texts_of, written

SHINGLE, RADIUS, SEED = 3, 2, 42
SHARD_NODES = 1024
STEP = 65_536  # shingles counted at once


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, counts, digest, join = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_digest, b" ".join
    for i in range(0, n, STEP):
        part = words[i : i + STEP + shingle - 1]
        hashes = b"".join([digest(join(s), seed) for s in zip(*(part[k:] for k in range(shingle)))])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


Keep = Callable[[DataFrame, str], DataFrame]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (a long that holds the 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            yield pa.record_batch([b.column("doc_id"), pa.array([signed(fingerprint(t)) for t in texts_of(b)], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Fingerprints with children keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        if not self.values:
            return []
        found, open_ = [], [0]
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (down := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = down


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for each value that is linked, straight or through others of the shard, to its root."""
    tree, parent = BkTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            if (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def _bits(fp, start: int, n: int):
    return F.shiftrightunsigned(fp, start).bitwiseAND((1 << n) - 1)


def links(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES, keep: Keep = written) -> DataFrame:
    """(a, b) links between fingerprints of nodes(fp), enough to span every component."""
    if radius != 2:
        raise ValueError("the shard keys are made for a radius of 2")
    fp = F.col("fp")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    # used: the bits that the key fixes
    keys = [F.struct(F.lit(str(k)).alias("path"), F.shiftleft(_bits(fp, 16 * i, 16), 16).bitwiseOR(_bits(fp, 16 * j, 16)).alias("value"), F.lit(k).alias("kind")) for k, (i, j) in enumerate(pairs)]
    level = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.xxhash64("k.path", "k.value").alias("key"), "k.kind")
    free = {k: [b for p in range(4) if p not in pair for b in range(16 * p, 16 * p + 16)] for k, pair in enumerate(pairs)}
    out = None
    while True:
        hot = keep(level.groupBy("key", "kind").agg(F.count("*").alias("n")).where(F.col("n") > shard_nodes).select("key", "kind"), "simhash-hot")
        some = not hot.isEmpty()
        small = level.join(hot, ["key", "kind"], "left_anti") if some else level
        got = _linked(small, radius)
        out = got if out is None else out.union(got)
        if not some:
            return out
        # parts of the free bits; where none are left, equal keys mean equal fingerprints, of which nodes has one each
        again, next_free = [], {}
        for kind, bits in free.items():
            size = -(-len(bits) // 3)
            for part in (bits[:size], bits[size : 2 * size], bits[2 * size :]):
                if part:
                    new = len(next_free)
                    next_free[new] = [b for b in bits if b not in part]
                    runs = [_bits(fp, b, 1) for b in part]
                    again.append((kind, new, F.xxhash64("key", *runs, F.lit(new))))
        if not again:
            return out
        rows = level.join(hot, ["key", "kind"], "left_semi")
        each = F.array(*(F.when(F.col("kind") == kind, F.struct(key.alias("key"), F.lit(new).alias("kind"))) for kind, new, key in again))
        level = keep(rows.select("fp", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k")).select("fp", "k.key", "k.kind"), "simhash-level")
        free = next_free


def _linked(level: DataFrame, radius: int) -> DataFrame:
    """Links within each (kind, key); rows of a key come together in a sorted partition, at most shard_nodes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = [], None

        def done() -> pa.RecordBatch | None:
            found = shard_links([x & (2**64 - 1) for x in shard], radius) if len(shard) > 1 else []
            return pa.record_batch([pa.array([signed(x) for x in c], pa.int64()) for c in zip(*found)], names=["a", "b"]) if found else None

        for b in batches:
            for fp, *key in zip(*(b.column(c).to_pylist() for c in ("fp", "key", "kind")), strict=True):
                if key != at:
                    if r := done():
                        yield r
                    shard, at = [], key
                shard.append(fp)
        if r := done():
            yield r

    return level.repartition("key", "kind").sortWithinPartitions("kind", "key", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, keep: Keep = written) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) can reach. keep() writes the state of each round."""
    pairs = lambda a, b: edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = keep(pairs("a", "b").where("u <> v").distinct(), "components")
    told = None
    while True:
        both = state.union(state.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m").toDF("u", "v")).where("u <> v").distinct()
        seen = Observation()
        state = keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "components")
        now = seen.get
        if now == told:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """doc_id, fp, component_id of every row, written in the shared folder."""
    with Scratch(docs.sparkSession) as keep:
        marked = keep(fingerprints(docs, text, doc_id), "simhash")
        nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
        found = components(links(nodes.select("fp"), radius, shard_nodes, keep), keep)
        rooted = keep(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
        named = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "simhash-named")
        by_fp = keep(join_hot(rooted, named, "root", "nodes").select("fp", "copies", "component_id"), "simhash-by-fp")
        return written(join_hot(marked, by_fp, "fp", "copies").select("doc_id", "fp", "component_id"), "simhash-groups")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
