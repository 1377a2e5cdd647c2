"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, a local one for a session within one machine."""
    at = spark.conf.get(CHECKPOINT_KEY, None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        at = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not at:
            at = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def _write(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it again: cuts the lineage, survives executors."""
    return _write(df, name)[0]


class Scratch:
    """Writes tables in the shared folder as written() does, and deletes them where the with-block ends.

    What an operator returns must not read them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        out, at = _write(df, name, *by)
        self.paths.append(at)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for at in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, or a longer one that none of the columns has (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs and the name of a long column of it that has another value in each row, the same in every read: doc_id where
    that holds, else a number in a copy that keep() writes."""
    if dict(docs.dtypes).get(doc_id) == "bigint" and docs.groupBy(doc_id).count().where((F.col("count") > 1) | F.col(doc_id).isNull()).isEmpty():
        return docs, doc_id
    name = fresh("row_number", docs.columns)
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


HOT = 10_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, copies: str, how: str = "left", small: Column | None = None) -> DataFrame:
    """rows joined with side, which has one row for each key and, in `copies`, how many rows have it.

    A key of more than one in HOT of all rows would be one task's work. There are HOT such keys at most, so they are
    broadcast (those that are `small`, where side's rows have no bounded size); the others are joined by the shuffle.
    """
    total = side.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    hot = F.col(copies) > max(total // HOT, 1)
    many = side.where(hot if small is None else hot & small)
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(side, key, how)
    return rows.join(F.broadcast(many), key).unionByName(rest)


MOST_BITS = 1 << 27  # of a sieve: 16 MB, whatever the number of ids


def sieve(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of a long column for the ids of a one-column table: true for all of them and for few others.

    A bit for each id's hash, at least 16 bits an id up to MOST_BITS. The more ids there are beyond that, the more others
    pass, so that a join must follow it; it only spares most rows the shuffle.
    """
    bits = 1 << min(max(16 * ids.count(), 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)).cast("int")
    marks = ids.select(place(F.col(ids.columns[0])).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("bit"))
    got = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(BooleanType())  # without pandas, which takes 24 MB of each Python worker
    def passes(at: pa.Array) -> pa.Array:
        x = at.to_numpy()
        return pa.array((shared.value[x >> 6] >> (x & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda c: passes(place(c))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], rows: int, size: int = 4_000_000, text: str = "text", owner: object = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most `rows` rows and about `size` bytes of text, for bounded memory.

    Word caches of others than the owner are emptied first; at the end memory held in reserve is given back.
    """
    WordCache.release(owner)
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (i - begin >= rows or total + n > size):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()


def give_back() -> None:
    """Return what a Python worker holds in reserve: it lives on, idle, while others need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library's, where it has one
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null is the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordCache(dict):
    """word -> make(word), made at the first look-up, in about `mb` MB at most if turn() is called now and then.

    Two generations, so that frequent words stay; words of over 256 characters go at the next turn. The caches of one owner alone
    are filled in a Python worker: the first look-up of another owner's empties them, and calls `emptied`.
    """

    ENTRY = 250  # bytes of an entry without its word and value, about
    owner: object = None
    filled: list[WordCache] = []

    def __init__(self, make: Callable[[str], object], mb: float, owner: object = None, value_bytes: int = 150, emptied: Callable[[], None] | None = None):
        super().__init__()
        self.emptied = emptied
        self.make, self.most, self.of, self.value_bytes = make, mb * 1e6 / 2, owner or self, value_bytes
        self.old, self.long, self.chars, self.listed = {}, [], 0, False

    def __missing__(self, word: str):
        self.claim()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 256:
            self[word] = value
            self.chars += len(word)
        return value

    def fill(self, words: set[str], make: Callable[[list[str]], Iterable]) -> None:
        """Look up many words at once: make() gets a list of the new ones."""
        self.claim()
        new = words - self.keys()
        again = new & self.old.keys()
        self.update((w, self.old[w]) for w in again)
        new = list(new - again)
        self.update(zip(new, make(new), strict=True))
        self.long += [w for w in new if len(w) > 256]
        self.chars += sum(map(len, new))

    def claim(self) -> None:
        if not self.listed:
            WordCache.release(self.of)
            WordCache.owner = self.of
            WordCache.filled.append(self)
            self.listed = True

    @staticmethod
    def release(owner: object) -> None:
        """Empty the caches of any other owner."""
        if WordCache.owner is not owner:
            filled, WordCache.owner, WordCache.filled = WordCache.filled, None, []
            for c in filled:
                c.empty()
                if c.emptied:
                    c.emptied()
            c = None  # else the last one lives on until give_back() has run
            if filled:
                give_back()

    def empty(self) -> None:
        self.clear()
        self.old, self.long, self.chars, self.listed = {}, [], 0, False

    def turn(self) -> None:
        for w in self.long:
            self.chars -= len(w) if self.pop(w, None) is not None else 0
        self.long = []
        if len(self) * (self.ENTRY + self.value_bytes) + self.chars > self.most:
            self.old, self.chars = dict(self), 0
            self.clear()
