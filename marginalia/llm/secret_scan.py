"""Secret scans by corpus-wide ownership frequency.

Every text is scanned for candidate credentials. A candidate's hash is then counted over the whole corpus by distinct
repositories and owners: a value that many owners hold is a widely copied example, a value that stays with few
owners is owner-specific. An owner-specific candidate that also looks live (its characters are near random) is a finding.

Defined results: a null text is empty; a null repository or owner counts as one unnamed owner or repository; rows are
kept one by one, also with equal or null ids; spans that start together: by kind; a very long text is scanned whole, in
time that grows with its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, fresh, join_hot, numbered, sieve, slices, table, texts_of, written

KINDS = ("assign", "access", "hex", "pem", "jwt", "vendor", "opaque")
BASE = 3  # of KINDS, those that stay in any case
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more are the matches of [0-9a-f]+ that are kept
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s:,._]|-(?!----))*+)-----END [A-Z0-9 ]*PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
VENDOR = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{12,}|AIza[A-Za-z0-9_-]{35})")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")

SPAN = "struct<kind:int,start:int,end:int,hash:string,live:boolean>"
SCAN_SCHEMA = f"row long, doc_id long, repo string, owner string, spans array<{SPAN}>"


def entropy(value: str) -> float:
    """Bits per character by the value's own frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value)))


def looks_live(kind: int, value: str) -> bool:
    if kind == 3:
        return True
    mixed = any(x.isdigit() for x in value) and any(x.isalpha() for x in value)
    return mixed and entropy(value) >= 3.0


def _free(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch meets none of the spans."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return lambda s, e: (k := bisect_left(starts, e)) == 0 or ends[k - 1] <= s


def find_spans(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(kind, start, end, hash of the value, looks live) by start, then kind, in code points."""
    found = []

    def add(kind: int, start: int, end: int, value: str) -> None:
        found.append((kind, start, end, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:32], looks_live(kind, value)))

    # a cheap test for the few first characters spares most texts the slow pattern
    if KEYWORDS.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                add(0, m.start(), m.end(), m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                add(1, m.start(), m.end(), m[0])
    for m in HEX.finditer(text):
        add(2, m.start(), m.end(), m[0])
    free = _free([(s, e) for _, s, e, _, _ in found])
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if len(m[1]) >= 40:  # a key may hold base spans
                add(3, m.start(), m.end(), m[0])
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if free(m.start(), m.end()):
                add(4, m.start(), m.end(), m[0])
    if "_" in text or "-" in text or "AIza" in text:
        for m in VENDOR.finditer(text):
            if free(m.start(), m.end()):
                add(5, m.start(), m.end(), m[0])
    free = _free([(s, e) for _, s, e, _, _ in found])
    for m in OPAQUE.finditer(text):
        v = m[0]
        if any(x.isdigit() for x in v) and any(x.islower() for x in v) and any(x.isupper() for x in v) and free(m.start(), m.end()):
            add(6, m.start(), m.end(), v)
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repo: Column | None = None, owner: Column | None = None, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """One row per row of docs, with a row number of its own and all candidate spans, as a table that keep() writes."""
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        (none if repo is None else repo.cast("string")).alias("repo"), (none if owner is None else owner.cast("string")).alias("owner"),
    )
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            spans = [[dict(zip(("kind", "start", "end", "hash", "live"), s, strict=True)) for s in find_spans(t)] for t in texts_of(b)]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("repo"), b.column("owner"), pa.array(spans, pa.list_(kind))], names=["row", "doc_id", "repo", "owner", "spans"])

    return keep(rows.mapInArrow(run, SCAN_SCHEMA), "secret-scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash -> n_docs, n_repos, n_owners over the corpus. Pre-aggregated by hash, owner and repository, so that a value
    in a third of all rows is summed where it lies before anything is shuffled."""
    one = (
        scanned.where(F.size("spans") > 0)
        .select("row", "repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
        .groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
        .agg(F.count("*").alias("n"))
    )
    return one.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def secret_findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repo: Column | None = None, owner: Column | None = None, max_owners: int = 2, max_repos: int = 4, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """One row per row of docs: row, doc_id, and spans, an array of (kind, start, end, n_docs, n_repos, n_owners,
    owner_specific) that holds every base span and, of the wider kinds, the owner-specific live-looking ones.

    A value is owner-specific if at most max_owners owners and max_repos repositories hold it.
    """
    scanned = scan(docs, text, doc_id, repo, owner, keep)
    common = keep(ownership(scanned).where((F.col("n_owners") > 1) | (F.col("n_repos") > 1) | (F.col("n_docs") > 1)), "secret-owners")
    each = scanned.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", F.col("s.*"))
    judged = join_hot(each, common, "hash", "n_docs").select(
        "row", "kind", "start", "end", "live",
        *(F.coalesce(c, F.lit(1)).cast("long").alias(c) for c in ("n_docs", "n_repos", "n_owners")),
    )
    judged = judged.withColumn("owner_specific", F.col("live") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    kept = judged.where((F.col("kind") < BASE) | F.col("owner_specific"))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_docs", "n_repos", "n_owners", "owner_specific"))).alias("spans"))  # of one text each
    return scanned.select("row", "doc_id").join(spans, "row", "left")


def digest_columns(found: DataFrame) -> DataFrame:
    """The per-document digest of secret_findings."""
    names = F.array(*map(F.lit, KINDS))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(show(base), "utf-8"), 256).alias("base_sha256"), show(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["owner_specific"])).cast("long").alias("n_owner_specific"),
        F.size(F.filter(spans, lambda s: ~s["owner_specific"])).cast("long").alias("n_widely_copied"),
    )


def owner_columns(docs: DataFrame) -> dict[str, Column]:
    """In `documents`, a source is an owner and its documents of one language are a repository."""
    return {"owner": F.col("source"), "repo": F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest_columns(secret_findings(docs, **owner_columns(docs)))


@F.arrow_udf(StringType())
def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts with each of their spans, which are in order, as [kind]. The pieces are joined once, so time grows with
    the text and its spans. Of spans that overlap, a later one that begins inside an earlier one is left to that."""
    out = []
    for t, found in zip(text, spans, strict=True):
        t, at, pieces = t.as_py() or "", 0, []
        for s in found.as_py() or ():
            if s["start"] >= at:
                pieces += [t[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                at = s["end"]
        out.append("".join([*pieces, t[at:]]))
    return pa.array(out, pa.string())


def mask_secrets(docs: DataFrame, **limits: int) -> DataFrame:
    """The columns of docs; owner-specific live-looking values in the text become [kind]. Widely copied examples stay.

    Without a column source or lang all rows have one unnamed owner or language, as rows have where it is null. Rows without findings pass by a sieve and are not shuffled. docs is read several times, so it should be a table.
    """
    rows, row = numbered(docs, written)
    with Scratch(docs.sparkSession) as keep:
        plain = rows.select(F.col(row).alias("doc_id"), "text", *(c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")))
        found = secret_findings(plain, **owner_columns(plain), **limits, keep=keep)
        found = written(found.select("doc_id", F.filter("spans", lambda s: s["owner_specific"]).alias("spans")).where(F.size("spans") > 0), "mask-spans")
    marks = fresh("spans", rows.columns)
    found = found.toDF(row, marks)
    none = F.col(marks).isNull()
    new = {"text": F.when(none, F.col("text")).otherwise(masked(F.col("text"), F.col(marks)))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length(new["text"])).cast(docs.schema["n_chars"].dataType)
    maybe = sieve(found.select(row))(F.col(row))
    # by merge, so that no task has two Python workers at a time, the sieve's and the masks': they stay for later stages
    joined = rows.where(maybe).join(found.hint("merge"), row, "left")
    return rows.where(~maybe).select(*docs.columns).union(joined.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns)))
