"""Data versions: snapshots of input files, results kept by version, and stored tables that change in one step."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.sources.store import store_folder


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """(path, folder?, length, time) of a file, or of what is in a folder; one answer of the file system, no call a file."""
    fs, at = file_system(spark, path)
    told = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(at))
    found = re.findall(r"path=(.*?); isDirectory=(\w+);(?: length=(\d+);)?.*?modification_time=(\d+)", told)
    return [(p, d == "true", int(n or 0), int(t)) for p, d, n, t in found]


def snapshot_id(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """A digest of all files under the paths: names, sizes and times of change. None where they can't be listed."""
    rows, todo = [], list(paths)
    try:
        while todo:
            for path, folder, size, changed in listing(spark, todo.pop()):
                if folder:
                    todo.append(path)
                else:
                    rows.append(f"{path}|{size}|{changed}")
    except Exception:  # whatever the file system raises: the version is unknown, so nothing may be kept
        return None
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


class ResultCache:
    """Results of analyses, kept as Parquet by project, name, parameters and the data's version.

    A version that moves makes what was kept unreachable; it expires by itself. Without a version, or if it moves while a
    result is made, or if keeping fails, the result is computed and not kept. Every session that names the same
    spark.checkpoint.dir finds what others have kept.
    """

    #: Seconds that a result counts, bytes that it may have, one in how many writings looks for old ones.
    TTL, MAX_BYTES, PRUNE_ONE_IN = 43_200, 4_000_000, 50

    def __init__(self, spark: SparkSession, version: Callable[[], str | None], folder: str | None = None):
        self.spark, self.version, self.writes = spark, version, 0
        at = folder or store_folder(spark)
        self.folder = f"{at}/results" if at else None

    def get(self, project_id: int, name: str, params: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        before = self.version()
        if before is None or self.folder is None:
            return compute()
        at = f"{self.folder}/{self.key(project_id, name, params, before)}"
        try:
            fs, path = file_system(self.spark, at)
            if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < self.TTL:
                return self.spark.read.parquet(at)
        except Exception:
            return compute()
        value = compute()
        try:
            return self._keep(value, fs, path, before)
        except Exception:  # a full disk must not take the result away
            return value

    def _keep(self, value: DataFrame, fs, path, before: str) -> DataFrame:
        made = f"{self.folder}/made-{uuid.uuid4().hex}"
        value.write.parquet(made)
        _, fresh = file_system(self.spark, made)
        small = fs.getContentSummary(fresh).getLength() <= self.MAX_BYTES
        if self.version() != before:
            fs.delete(fresh, True)  # it may mix two states of the data
            return value
        self.writes += 1
        if self.writes % self.PRUNE_ONE_IN == 0:
            self.prune()
        if not small:
            return self.spark.read.schema(value.schema).parquet(made)
        if fs.exists(path):
            fs.delete(path, True)  # expired
        fs.rename(fresh, path)
        return self.spark.read.schema(value.schema).parquet(path.toString())

    def prune(self) -> int:
        """Delete what is too old to count; how many."""
        old = [p for p, _, _, changed in listing(self.spark, self.folder) if time.time() - changed / 1000 >= self.TTL]
        for p in old:
            fs, path = file_system(self.spark, p)
            fs.delete(path, True)
        return len(old)

    @staticmethod
    def key(project_id: int, name: str, params: dict, version: str) -> str:
        told = hashlib.sha256(f"{version}|{json.dumps(params, sort_keys=True)}".encode()).hexdigest()[:32]
        return f"p{project_id}.{re.sub(r'[^A-Za-z0-9_]', '_', name)}.{told}"


class Conflict(RuntimeError):
    """Another commit came first."""


class VersionedTable:
    """A table whose rows lie in buckets of their keys; a commit writes the touched buckets anew and nothing else.

    `versions/` holds a small file per version that names each bucket's folder. A new version is seen when its file gets its
    name, in one step; until then, and if anything fails before, readers see the version before. Of two commits upon one
    version the second raises Conflict. Old folders stay for those who read them until vacuum().
    """

    _open: set[str] = set()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """A new table with the rows. buckets: so many that a bucket is some hundred MB."""
        self = cls(rows.sparkSession, folder)
        head = {"version": 0, "keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "paths": {}}
        with self._commit(head) as commit:
            commit(rows, range(buckets))
        return self

    # ---- reading ----

    def version(self) -> int:
        return max((int(m[1]) for p, *_ in listing(self.spark, f"{self.folder}/versions") if (m := re.search(r"/v(\d+)\.json$", p))), default=0)

    def pending(self) -> bool:
        """Whether this process is writing a version that isn't there yet."""
        return self.folder in self._open

    def head(self, version: int | None = None) -> dict:
        at = f"{self.folder}/versions/v{version or self.version():09d}.json"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given, or of some of its buckets alone."""
        return self._rows(self.head(version), buckets)

    def _rows(self, head: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = head["paths"] if buckets is None else {str(b) for b in buckets} & set(head["paths"])
        schema, paths = StructType.fromJson(head["schema"]), sorted(head["paths"][b] for b in wanted)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, head: dict | None = None) -> Column:
        head = head or self.head()
        return F.pmod(F.xxhash64(*head["keys"]), F.lit(head["buckets"])).cast("int")

    def touched(self, keys: DataFrame, head: dict | None = None) -> list[int]:
        """The buckets of the rows' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(head)).distinct().collect())

    # ---- changing ----

    @contextmanager
    def _commit(self, head: dict):
        """Gives commit(rows, buckets), which writes the rows as all that these buckets have from now on."""
        fs, folder = file_system(self.spark, self.folder)
        data, at = f"{self.folder}/data/{uuid.uuid4().hex}", f"{self.folder}/versions"
        paths = dict(head["paths"])

        def commit(rows: DataFrame, buckets: Iterable[int]) -> None:
            name = "bucket_" + uuid.uuid4().hex[:8]  # no column has it
            rows = rows.select(*StructType.fromJson(head["schema"]).names).withColumn(name, self.bucket(head))
            rows.hint("rebalance", name).write.partitionBy(name).parquet(data)
            for b in buckets:
                paths.pop(str(b), None)
            for path, is_folder, *_ in listing(self.spark, data):
                if is_folder:
                    paths[path.rsplit("=", 1)[1]] = path

        self._open.add(self.folder)
        try:
            yield commit
            made = f"{at}/made-{uuid.uuid4().hex}"
            told = json.dumps(head | {"version": head["version"] + 1, "paths": paths})
            out = fs.create(file_system(self.spark, made)[1])
            out.write(bytearray(told.encode()))
            out.close()
            jvm = self.spark._jvm
            none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
            to = file_system(self.spark, f"{at}/v{head['version'] + 1:09d}.json")[1]
            try:
                context.rename(file_system(self.spark, made)[1], to, none)  # raises if the name is taken
            except Exception as e:
                if fs.exists(to):
                    raise Conflict(f"version {head['version'] + 1} of {self.folder} is there already") from e
                raise
        except BaseException:
            fs.delete(file_system(self.spark, data)[1], True)
            raise
        finally:
            self._open.discard(self.folder)

    def rewrite(self, buckets: Iterable[int], change: Callable[[DataFrame], DataFrame], head: dict | None = None) -> int:
        """Put change(rows of the buckets) in their place; the table's version afterwards. change must keep the keys' buckets."""
        head, buckets = head or self.head(), list(buckets)
        if not buckets:
            return head["version"]
        with self._commit(head) as commit:
            commit(change(self._rows(head, buckets)), buckets)
        return head["version"] + 1

    def upsert(self, new: DataFrame, order: Column) -> int:
        """Rows of new in place of those with equal keys; of new's equal keys the first by order. Null keys equal null."""
        head = self.head()
        keys, names = head["keys"], StructType.fromJson(head["schema"]).names
        rest = [c for c in names if c not in keys]
        first = new.groupBy(*keys).agg(F.min_by(F.struct(*(rest or [F.lit(0)])), order).alias("row_")).select(*keys, *(F.col("row_")[c].alias(c) for c in rest)).select(*names)
        return self.rewrite(self.touched(new, head), lambda old: without(old, first, keys).unionByName(first), head)

    def delete(self, gone: DataFrame) -> int:
        """Without the rows that have one of gone's keys."""
        head = self.head()
        return self.rewrite(self.touched(gone, head), lambda old: without(old, gone, head["keys"]), head)

    def replace(self, owners: DataFrame, new: DataFrame) -> int:
        """All rows of the owners' keys replaced by new ones; owners without new rows lose theirs, new rows of others are left out."""
        head = self.head()
        keys = head["keys"]
        own = owners.select(*keys).distinct()
        return self.rewrite(self.touched(own, head), lambda old: without(old, own, keys).unionByName(new.select(*old.columns).join(renamed(own, keys), same_keys(new, keys), "left_semi")), head)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last `keep` versions reads; how many folders."""
        last = self.version()
        used = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.head(v)["paths"].values()}
        gone = 0
        for commit, *_ in listing(self.spark, f"{self.folder}/data"):
            for path, is_folder, *_ in listing(self.spark, commit):
                if is_folder and path not in used:
                    fs, at = file_system(self.spark, path)
                    fs.delete(at, True)
                    gone += 1
        return gone


def renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*(F.col(k).alias(f"{k}_of") for k in keys))


def same_keys(rows: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return out


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(renamed(gone, keys), same_keys(rows, keys), "left_anti")
