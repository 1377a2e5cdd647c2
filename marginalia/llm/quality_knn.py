"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words' shapes ("Xx,", "9-9", "|"), signs of repetition, and hashed words. Their weighted counts
are projected on the main axes of a bounded labelled sample (a truncated SVD made on the driver from at most
`max_labels` rows of `DIMENSIONS` counts each). The projection and the labelled vectors have a fixed bound and go to
every executor; each document's cosines with all labelled vectors are exact, a block of documents at a time, and its
`neighbours` nearest vote with weights that rise with the cosine.

Scores see the text alone: labels, lang, source and ids are no input.

Defined results: a null text is empty; empty texts have the zero vector, no cosine, and get the share of good labels;
labelled vectors that tie with the last neighbour vote too, so no order matters; a very long text is one row of counts;
labels that are null or on unknown documents are not used; several labels of one document all vote; without any usable
label every score is 0.5; rows are kept one by one, also with equal or null ids; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, slices, table, texts_of

SHAPES, WORDS, EXTRA = 512, 512, 3
DIMENSIONS = SHAPES + WORDS + EXTRA
WORD_WEIGHT = 0.25
MAX_LABELS, AXES, NEIGHBOURS, SHARPNESS = 6000, 32, 40, 20.0
CACHE_MB = 60.0
PACK = struct.Struct("<3H").pack
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[0-9]+")


def shape(word: str) -> str:
    """Letters and digits by their kind, runs as one, signs as they are."""
    return RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "x" if m[0][0].islower() else "X" if len(m[0]) == 1 else "XX", word)


def _word(word: str) -> bytes:
    data = word.lower().strip(".,;:!?").encode("utf-8", "replace")
    h = zlib.crc32(data)
    return PACK(zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES, h % WORDS, h >> 16)


@functools.lru_cache(maxsize=1)
def _cache() -> WordCache:
    return WordCache(_word, CACHE_MB, value_bytes=40)


def counts(texts: list[str]) -> np.ndarray:
    """A row of term counts for each text."""
    cache, out = _cache(), np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not (words := text.split()):
            continue
        got = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint16).reshape(-1, 3)
        row[:SHAPES] = np.bincount(got[:, 0], minlength=SHAPES)
        row[SHAPES : SHAPES + WORDS] = np.bincount(got[:, 1], minlength=WORDS)
        code = got[:, 1].astype(np.uint32) << 16 | got[:, 2]
        n = len(code)
        # one repeated word alone is no sign
        shares = [max(0, np.count_nonzero(code[k:] == code[:-k]) - 1) / n if n > k else 0.0 for k in (1, 2, 3)]
        for k, share in enumerate(shares):  # repetition as counts of its own, in tenths
            row[SHAPES + WORDS + k] = round(10 * share)
    cache.turn()
    return out


def _packed(row: np.ndarray) -> bytes:
    """The places and values of a row's counts that are not zero: most are."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    row = np.zeros(DIMENSIONS, np.float32)
    row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return row


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # DIMENSIONS x k
    vectors: np.ndarray  # labels x k, of length 1
    labels: np.ndarray
    prior: float

    @staticmethod
    def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(c) * idf
        for part, weight in ((slice(0, SHAPES), 1.0), (slice(SHAPES, SHAPES + WORDS), WORD_WEIGHT)):
            x[:, part] *= weight / np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    def project(self, c: np.ndarray) -> np.ndarray:
        v = self.weighted(c, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, c: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS, block: int = 256) -> np.ndarray:
        out = np.full(len(c), self.prior)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for i in range(0, len(c), block):
            part = c[i : i + block]
            cos = self.project(part) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cos, near, 1).min(axis=1)
            w = np.exp(sharpness * np.take_along_axis(cos, near, 1))
            vote = (w * self.labels[near]).sum(1) / w.sum(1)
            for r in np.flatnonzero((cos >= least[:, None]).sum(axis=1) > k):  # all that tie with the last one vote
                tied = cos[r] >= least[r]
                vote[r] = np.average(self.labels[tied], weights=np.exp(sharpness * cos[r][tied]))
            out[i : i + block] = np.where(part.any(axis=1), vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def train(c: np.ndarray, labels: np.ndarray, axes: int = AXES) -> Model:
    if not len(labels):
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 0.2).astype(np.float32)
    x = Model.weighted(c, idf)
    values, basis = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(idf, basis[:, ::-1][:, :axes].astype(np.float32), np.zeros((0, 1), np.float32), labels, float(labels.mean()))
    return model._replace(vectors=model.project(c).astype(np.float32))


def bucket(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labels: int = MAX_LABELS, axes: int = AXES) -> Model:
    """A model of at most max_labels labelled rows, those first by a hash of their ids; held-out ids take no part."""
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 1))
        .select("doc_id", F.col(target).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labels)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, owner=_cache()):
            c = counts(texts_of(b))
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array([_packed(x) for x in c], pa.binary())], names=["doc_id", "label", "counts"])

    got = rows.mapInArrow(run, "doc_id long, label double, counts binary").orderBy("doc_id", "label", "counts").limit(max_labels).collect()
    c = np.array([_unpacked(bytes(r.counts)) for r in got], np.float32).reshape(-1, DIMENSIONS)
    return train(c, np.array([r.label for r in got], np.float64), axes)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most, by max_labels and axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, owner=_cache()):
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.score(counts(texts_of(b))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(bucket(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least so much."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, owner=_cache()):
            good = shared.value.score(counts(texts_of(b))) >= at_least
            yield b.filter(pa.array(good))

    return docs.select(*names).mapInArrow(run, kinds)
