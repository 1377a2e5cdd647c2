"""Near duplicates: texts whose five-word shingles have a Jaccard similarity of at least 0.8, and the groups they form.

Fingerprints of 64 bits that differ in two bits at most find few such pairs, so the shingles themselves decide here, in two
steps; the second is exact whatever the first has found.

1. Families. Shingles fall into classes by their hashes; the SimHashes of some small classes are a text's keys. Texts that
   share a key meet in blocks. In each, a BK-tree over parity sketches gives those within the distance that the
   threshold allows, and their shingles are compared. Then one text of each group and key meets the other groups' texts.
2. What is left. Similar texts share one of the first shingles of each (its prefix) in one order for all texts, rare ones
   first. Texts of different groups that share such a shingle are candidates if sizes, places and sketches allow it; the
   shingles of what passes are compared. A shingle with many texts is dealt out: its texts outside the largest group
   meet one another, and the largest group, block by block in tasks of their own. So no pair is left out.

A parity sketch has a bit for each bucket of hashes, set if the bucket holds an odd number of the text's shingles. Two
sketches differ in at most as many bits as there are shingles in one text only, so a bound on the one holds for the other.

Defined results: a null text is empty; texts without words are equal; one with fewer words than a shingle is one shingle;
equal texts, however many, are one node; an empty table gives no rows; other columns are ignored; a very long text is
one node like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, sieve, slices, texts_of, written
from .simhash_groups import SEED, BkTree, components, signed

SHINGLE, SIMILARITY = 5, 0.8
CLASS_SHINGLES, CLASSES = 4, 6
BLOCK_NODES, BLOCK_SHINGLES = 512, 2_000_000  # of a block of texts that share a key
GROUP_ROWS = 256  # texts that share a prefix shingle and meet in one step
MARK_BITS = 512  # of the short sketches that go with shared shingles
SAMPLE_ROWS, SAMPLE_SHARE, COMMON = 4000, 64, 200_000  # for the order of shingles only


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of the text's shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.unique(np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]), ">u8").astype(np.uint64))


# ---- what a text is known by ----


def parity_sketch(hashes: np.ndarray, bits: int | None = None) -> bytes:
    """Bits of which each says whether its bucket of hashes holds an odd number; two for each shingle, or so many."""
    bits = bits or 1 << min(max(int(2 * len(hashes) - 1).bit_length(), 6), 15)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, bits: int) -> int:
    """The sketch with fewer buckets."""
    value, have = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while have > bits:
        have //= 2
        value = (value >> have) ^ (value & ((1 << have) - 1))
    return value


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the lesser size."""
    bits = 8 * min(len(x), len(y))
    return (folded(x, bits) ^ folded(y, bits)).bit_count()


def most_apart(sizes, similarity: float):
    """Shingles that similar texts with so many shingles in sum may have in one of them only."""
    return np.floor((1 - similarity) / (1 + similarity) * sizes + 1e-9)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some shingle hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def class_fingerprints(hashes: np.ndarray) -> list[int]:
    """SimHashes of small classes of a text's shingles.

    Shingles fall into 2^level classes by the low bits of their hashes, about CLASS_SHINGLES in each; CLASSES of them
    stand for the text. An edit changes few shingles, so most near copies agree in a class. Texts near the border of two
    levels have both. These keys only find the bulk of the links cheaply.
    """
    n = len(hashes)
    size = np.log2(max(n, 1) / CLASS_SHINGLES)
    out = []
    for level in {max(0, int(np.floor(size - 0.15))), max(0, int(np.floor(size + 0.15)))}:
        of = hashes & np.uint64((1 << level) - 1)
        for c in range(min(CLASSES, 1 << level)):
            if len(own := hashes[of == c]):
                out.append(xxhash.xxh64_intdigest(f"{level}:{c}:{majority(own)}:{len(own)}", SEED))
    return out


def needed(size, similarity: float):
    """The least number of shingles that a text of `size` shares with a similar one."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def rare_prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of the text by one order for all texts, so many that similar texts have one of them in common.

    Any fixed order is exact; that of `common` (sorted hashes and their counts in a sample) puts common shingles last, so
    that few texts meet.
    """
    if not len(hashes):
        return hashes
    listed, counts = common
    rank = np.zeros(len(hashes), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        rank = np.where(listed[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - int(needed(len(hashes), similarity)) + 1]


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the shingles that several texts of a sample share, the COMMON most frequent at most.
    They set an order and decide no result."""
    share = max(1, min(texts.count() // SAMPLE_ROWS, SAMPLE_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            yield pa.record_batch([pa.array(np.concatenate([shingle_hashes(t) for t in texts_of(b)]).view(np.int64))], names=["hash"])

    found = texts.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 2")
    got = found.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, counts = got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


# ---- families ----


def similar_links(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(node, linked node) pairs that span the components of one block.

    Each node looks up those before it in a BK-tree and is compared with them, those with most links first, until it has
    met one of each component or all; so a family of copies costs about one comparison a node.
    """
    sketches = [parity_sketch(s) for s in sets]
    bits = 8 * min(map(len, sketches))
    tree, parent, links_of, found = BkTree(), list(range(len(nodes))), [0] * len(nodes), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, (own, sketch) in enumerate(zip(sets, sketches, strict=True)):
        value = folded(sketch, bits)
        # a similar text has at most size / similarity shingles
        for j in sorted(tree.within(value, int(most_apart(len(own) * (1 + 1 / similarity), similarity))), key=lambda k: -links_of[k]):
            if root(j) != root(i) and similar(own, sets[j], similarity):
                found.append((nodes[i], nodes[j]))
                links_of[i] += 1
                links_of[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
        tree.add(value)
    return found


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links of each block of rows(key, block, row, shingles); a block's rows come together, a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, at = [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1 and (found := similar_links(nodes, sets, similarity)):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for b in slices(batches, 1000, text="shingles"):
            for key, block, row, s in zip(*(b.column(c).to_pylist() for c in ("key", "block", "row", "shingles")), strict=True):
                if (key, block) != at:
                    yield from done()
                    nodes, sets, at = [], [], (key, block)
                nodes.append(row)
                sets.append(np.frombuffer(s, "<u8"))
        yield from done()

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "row").mapInArrow(run, "a long, b long")


def _shingles(texts: DataFrame, rows: DataFrame, keep: Scratch) -> DataFrame:
    """row and shingles of the given rows; the others' texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            yield pa.record_batch([b.column("row"), pa.array([shingle_hashes(t).astype("<u8").tobytes() for t in texts_of(b)], pa.binary())], names=["row", "shingles"])

    rows = keep(rows.distinct(), "near-rows")
    # by merge, so that no task has two Python workers at a time
    return keep(texts.where(sieve(rows)(F.col("row"))).join(rows.hint("merge"), "row", "left_semi").mapInArrow(run, "row long, shingles binary"), "near-shingles")


def _in_blocks(level: DataFrame, block_nodes: int) -> DataFrame:
    """level(row, key, n, shingles) with a block of its key, by the number of texts and of their shingles."""
    blocks = F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    return level.select("row", "key", F.pmod(F.xxhash64("row", "key"), blocks).alias("block"))


def merged(rooted: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """rooted(row, root) after links(a, b) between rows joined their groups: components of the roots."""
    ends = links.join(rooted.toDF("a", "ra"), "a").join(rooted.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(ends, keep).toDF("root", "new")
    return keep(rooted.join(found, "root", "left").select("row", F.coalesce("new", "root").alias("root")), "near-rooted")


def families(texts: DataFrame, keyed: DataFrame, rooted: DataFrame, keep: Scratch, similarity: float, block_nodes: int) -> DataFrame:
    """rooted(row, root) after the links between rows that share keys; keyed has row, key and size."""
    sums = F.count("*").alias("n"), F.sum("size").alias("shingles")
    shared = keep(keyed.join(keyed.groupBy("key").agg(*sums).where("n > 1"), "key"), "near-shared-keys")
    if shared.isEmpty():
        return rooted
    sets = _shingles(texts, shared.select("row"), keep)
    # first by the key that most texts share, then by all keys with one text of each group
    level = shared.groupBy("row").agg(F.max(F.struct("n", "shingles", "key")).alias("k")).select("row", "k.*")
    for again in (False, True):
        if again:
            one = shared.join(rooted, "row").groupBy("key", "root").agg(F.min("row").alias("row"), F.max("size").alias("size"))
            one = keep(one, "near-groups")
            level = one.join(one.groupBy("key").agg(*sums).where("n > 1"), "key").select("row", "key", "n", "shingles")
        found = keep(_linked(_in_blocks(level, block_nodes).join(sets, "row"), similarity), "near-links")
        rooted = merged(rooted, found, keep)
    return rooted


# ---- what is left ----


COLUMNS = ["row", "root", "size", "at"]


def possible(a: np.ndarray, b: np.ndarray, a_marks: np.ndarray, b_marks: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of two tables of (row, root, size, place of the shared shingle) the shingle leaves possible: those of
    different groups, with sizes and shingles from it on that suffice, and marks that allow it."""
    sizes = a[:, 2] + b[:, 2]
    least = np.ceil(similarity / (1 + similarity) * sizes - 1e-9)
    ok = np.flatnonzero((a[:, 1] != b[:, 1]) & (np.minimum(a[:, 2] - a[:, 3], b[:, 2] - b[:, 3]) >= least))
    differ = np.bitwise_count(a_marks[ok] ^ b_marks[ok]).sum(axis=1, dtype=np.int64)
    return ok[differ <= most_apart(sizes[ok], similarity)]


def met(keys: np.ndarray, rows: np.ndarray, marks: np.ndarray, similarity: float) -> np.ndarray:
    """The possible (row, row) pairs of all keys at once; keys is sorted."""
    out, i, step = [np.zeros((0, 2), np.int64)], np.arange(len(keys)), 1
    while len(i := i[i + step < len(keys)]) and len(i := i[keys[i] == keys[i + step]]):
        k = i[possible(rows[i], rows[i + step], marks[i], marks[i + step], similarity)]
        out.append(np.sort(np.stack([rows[k, 0], rows[k + step, 0]], axis=1), axis=1))
        step += 1
    return np.unique(np.concatenate(out), axis=0)


def meetings(one: np.ndarray, other: np.ndarray, one_marks: np.ndarray, other_marks: np.ndarray, similarity: float) -> np.ndarray:
    """The possible (row, row) pairs of each row of one block with each of another."""
    out = [np.zeros((0, 2), np.int64)]
    for i in range(0, len(one), 64):
        a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + 64, len(one))), np.arange(len(other)), indexing="ij"))
        k = possible(one[a], other[b], one_marks[a], other_marks[b], similarity)
        out.append(np.sort(np.stack([one[a[k], 0], other[b[k], 0]], axis=1), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _table(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("mark").to_pylist()), "<u8").reshape(-1, MARK_BITS // 64)


def _by_key(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, table of the columns, marks) of a sorted partition, a batch at a time; no key is parted."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        new = _table(b, by), _table(b, columns), _marks(b)
        keys, rows, marks = new if kept is None else (np.concatenate(x) for x in zip(kept, new, strict=True))
        begin = len(keys) - int((keys[::-1] == keys[-1]).all(axis=1).cumprod().sum())  # the last key may go on
        if begin:
            yield keys[:begin], rows[:begin], marks[:begin]
        kept = keys[begin:], rows[begin:], marks[begin:]
    if kept:
        yield kept


def _pairs(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(found):
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _met(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b) candidates of shared(key, row, root, size, at, mark), a few rows for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows, marks in _by_key(batches, ["key"], COLUMNS):
            yield from _pairs(met(keys[:, 0], rows, marks, similarity))

    return shared.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _dealt(shared: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """(a, b) candidates of keys with many rows. A key's rows outside its largest group are cut into blocks, the largest
    group too; each two of the former, and each of the former with each of the latter, are a task of their own."""
    by_root = shared.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    parts = lambda n: F.ceil(n / group_rows).cast("long")
    sizes = sizes.select("key", F.col("top.root").alias("largest"), parts(F.col("n") - F.col("top.n")).alias("blocks"), parts(F.col("top.n")).alias("chunks"))
    rows = shared.join(sizes, "key").withColumn("inside", F.col("root") == F.col("largest"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("row", "key"), F.when(F.col("inside"), F.col("chunks")).otherwise(F.col("blocks"))))
    own = F.col("own")
    task = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.cast("long").alias("first"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_all = F.transform(upto(F.col("blocks")), lambda i: task(i, -1 - own, F.lit(0)))
    with_others = F.concat(
        F.transform(upto(F.col("blocks")), lambda j: task(F.least(own, j), F.greatest(own, j), own <= j)),
        F.transform(upto(F.col("chunks")), lambda c: task(own, -1 - c, F.lit(1))),
    )
    each = rows.select("key", *COLUMNS, "mark", F.explode(F.when(F.col("inside"), with_all).otherwise(with_others)).alias("task")).select("*", "task.*").drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows, marks in _by_key(batches, ["key", "i", "j"], [*COLUMNS, "first"]):
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                own, m = rows[i:j], marks[i:j]
                one = own[:, 4] == 1
                other = one if one.all() else ~one
                yield from _pairs(meetings(own[one], own[other], m[one], m[other], similarity))

    return each.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, keep: Scratch, similarity: float) -> DataFrame:
    """The similar ones of pairs(a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in slices(batches, 1000, text="shingles"):
            found = []
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                if b is None:  # a's own row comes before its partners
                    at, own = a, np.frombuffer(s, "<u8")
                elif a == at and similar(own, np.frombuffer(s, "<u8"), similarity):
                    found.append((a, b))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    sets = _shingles(texts, pairs.select(F.col("a").alias("row")).union(pairs.select("b")), keep)
    partners = pairs.select("a", "b").join(sets.select(F.col("row").alias("b"), "shingles"), "b").select("a", "b", "shingles")
    both = sets.select(F.col("row").alias("a"), F.lit(None).cast("long").alias("b"), "shingles").union(partners)
    return keep(both.repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long"), "near-verified")


def missed_links(texts: DataFrame, rooted: DataFrame, marked: DataFrame, keep: Scratch, similarity: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rooted after the links between all similar rows of different roots. rooted has row and root of one row of each set of
    shingles, marked also size, sketch and prefix of all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000, text="prefix"):
            parts = [np.frombuffer(x, "<i8") for x in b.column("prefix").to_pylist()]
            n = [len(x) for x in parts]
            rows = np.repeat(np.arange(len(n)), n)
            if len(rows):
                at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                columns = [b.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("row", "root", "size")]
                yield pa.record_batch([pa.array(np.concatenate(parts)), *map(pa.array, columns), pa.array(at)], names=["key", "row", "root", "size", "at"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000, text="s"):
            a, other, s, t, size = (b.column(c).to_pylist() for c in ("a", "b", "s", "t", "size"))
            d = [apart(x, y) for x, y in zip(s, t, strict=True)]
            ok = [k for k in range(len(a)) if d[k] <= most_apart(size[k], similarity)]
            yield pa.record_batch([pa.array([c[k] for k in ok], pa.int64()) for c in (a, other, d)], names=["a", "b", "apart"])

    single = marked.select("row", "size", "prefix").join(rooted, "row").select("row", "root", "size", "prefix")
    keyed = single.mapInArrow(each, "key long, row long, root long, size long, at long").repartition("key")
    # all columns take part in both branches, so that Spark shuffles the rows once
    every = F.struct("root", "row", "size", "at")
    live = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(every).alias("lo"), F.max(every).alias("hi")).where("lo.root <> hi.root").select("key", "n")
    shared = keep(keyed.join(live, "key"), "near-shared")
    shared = shared.join(marked.select("row", "mark"), "row")
    pairs = _met(shared.where(F.col("n") <= group_rows), similarity)
    many = shared.where(F.col("n") > group_rows)
    if not many.isEmpty():
        pairs = pairs.union(_dealt(many, similarity, group_rows))
    pairs = keep(pairs.distinct(), "near-pairs")
    of = marked.select("row", "sketch", "size")
    both = pairs.join(of.toDF("a", "s", "m"), "a").join(of.toDF("b", "t", "n"), "b").select("a", "b", "s", "t", (F.col("m") + F.col("n")).alias("size"))
    near = keep(both.mapInArrow(close, "a long, b long, apart long"), "near-close")
    # the closest pair of each two groups first: most of the others then lie within one group
    ends = lambda p, r: p.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b").where("ra <> rb")
    first = ends(near, rooted).groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
    first = keep(first, "near-first")
    if first.isEmpty():
        return rooted
    rooted = merged(rooted, _verified(first, texts, keep, similarity), keep)
    rest = keep(ends(near, rooted).select("a", "b").join(first, ["a", "b"], "left_anti"), "near-rest")
    return rooted if rest.isEmpty() else merged(rooted, _verified(rest, texts, keep, similarity), keep)


def near_duplicates(docs: DataFrame, text: str = "text", row: str = "row", similarity: float = SIMILARITY, block_nodes: int = BLOCK_NODES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """row and root of every row of docs, written in the shared folder: rows whose texts are equal, or linked by a
    similarity of at least `similarity`, have the same root. `row` is a long column with another value in each row."""
    texts = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts))  # COMMON pairs of numbers at most

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            sets = [shingle_hashes(t) for t in texts_of(b)]
            nodes = [signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
            keys = [[signed(x) for x in class_fingerprints(s)] for s in sets]
            prefixes = [rare_prefix(s, similarity, common.value).astype("<u8").tobytes() for s in sets]
            cells = (nodes, pa.int64()), (map(len, sets), pa.int64()), (map(parity_sketch, sets), pa.binary()), ([parity_sketch(s, MARK_BITS) for s in sets], pa.binary()), (keys, pa.list_(pa.int64())), (prefixes, pa.binary())
            yield pa.record_batch([b.column("row"), *(pa.array(c, t) for c, t in cells)], names=["row", "node", "size", "sketch", "mark", "keys", "prefix"])

    with Scratch(docs.sparkSession) as keep:
        marked = keep(texts.mapInArrow(sketch, "row long, node long, size long, sketch binary, mark binary, keys array<long>, prefix binary"), "near-sketch")
        least = marked.groupBy("node", "size").agg(F.min("row").alias("first"))
        members = keep(marked.select("row", "node", "size").join(least, ["node", "size"]).select("row", "first"), "near-members")
        single = members.where("row = first").select("row")
        keyed = keep(marked.select("row", "size", "keys").join(single, "row").select("row", "size", F.explode("keys").alias("key")), "near-keys")
        rooted = keep(single.withColumn("root", F.col("row")), "near-rooted")
        rooted = families(texts, keyed, rooted, keep, similarity, block_nodes)
        rooted = missed_links(texts, rooted, marked, keep, similarity, group_rows)
        out = written(members.join(rooted.toDF("first", "root"), "first").select("row", "root"), "near-roots")
    common.destroy()
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs: that with the least doc_id (of equal ids one; a
    null id only where all are null). docs is read several times, so it should be a table."""
    rows, row = numbered(docs, written, doc_id)
    roots = near_duplicates(rows, text, row, similarity)
    ids = roots if row == doc_id else roots.join(rows.select(F.col(row).alias("row"), F.col(doc_id).alias("real")), "row")
    real = F.col("row" if row == doc_id else "real")
    first = ids.groupBy("root").agg(F.min(F.struct(real.isNull().alias("none"), real.alias("id"), "row")).alias("first")).select(F.col("first.row").alias("row"))
    gone = written(roots.select("row").join(first, "row", "left_anti"), "near-gone").select(F.col("row").alias(row))
    maybe = sieve(gone)(F.col(row))
    # most rows are not among those that go: they need no join
    left = rows.where(maybe).join(gone.hint("merge"), row, "left_anti")
    return rows.where(~maybe).select(*docs.columns).union(left.select(*docs.columns))
