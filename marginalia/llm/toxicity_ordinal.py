"""Toxicity grades by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all ordered thresholds t_0 <= t_1 <= ...; x is sparse:
1 + log(count) of each vocabulary word. The vocabulary is the `MAX_WORDS` words at most that tell toxic from other texts
best, by a likelihood-ratio test of at least `LEAST_G` over a bounded sample of `max_labels` labelled rows, counted by
Spark. An L1 penalty then leaves few of them a weight, so scoring a text means looking up its words in a small table.

The labels say toxic or not. Grades are made from them: 0 if not toxic; toxic texts are split into three by how often
they use words that a two-grade fit of the same model marks as toxic (`CUTS`). Expected severity is the sum over j of
P(grade > j), from 0 to 3; the grade is the likeliest one.

Defined results: a null text is empty and is graded by the thresholds alone; null labels and labels of unknown
documents are not used; several labels of one document all count; without labels of both kinds every severity is 0; of
equally likely grades the least; a very long text is one row of counts;
rows are kept one by one, also with equal or null ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of, written

MAX_LABELS, MAX_WORDS, LEAST_G = 30_000, 2000, 20.0
L1, ROUNDS = 2e-4, 400
CUTS = (3, 6)  # uses of marked words from which a toxic text has grade 2, grade 3
MARKED = 0.25  # least weight of a marked word
SIGNS = ".,;:!?*#$%&|()[]{}\"'<>«»“”"
SCHEMA = "doc_id long, expected_severity double, grade int, p_toxic double, toxic int"


def words_of(text: str) -> list[str]:
    return [w.strip(SIGNS) for w in text.lower().split()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def predict(self, text: str) -> tuple[float, int, float]:
        """(expected severity, likeliest grade, P(grade > 0))."""
        if not self.thresholds:
            return 0.0, 0, 0.0
        found = Counter(w for w in words_of(text) if w in self.weights)
        z = sum(self.weights[w] * (1 + np.log(n)) for w, n in found.items())
        above = sigmoid(z - np.asarray(self.thresholds))
        each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
        return float(above.sum()), int(each.argmax()), float(above[0])


def cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_words: int, grade: np.ndarray, grades: int, l1: float = L1, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient on the mean log-likelihood of sparse rows."""
    n = len(grade)
    w, t = np.zeros(n_words), np.zeros(grades - 1)
    for j in range(grades - 1):
        p = np.clip((grade > j).mean(), 1e-4, 1 - 1e-4)
        t[j] = -np.log(p / (1 - p))
    # a diagonal that bounds the curvature (at most 0.5 in z): each word's values times its rows' sums
    row_sums = 2 + np.bincount(rows, values, n)
    step_w, step_t = 1 / (0.5 * np.bincount(cols, values * row_sums[rows], n_words) / n + 1e-9), 1 / (0.5 * row_sums.mean())
    v, before, k = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        z = np.bincount(rows, values * v[cols], n)
        # P(grade = g) = s(z - t_{g-1}) - s(z - t_g), with t_{-1} = -inf and t_{last} = inf
        s = np.column_stack([np.ones(n), *(sigmoid(z - x) for x in t), np.zeros(n)])
        d = s * (1 - s)
        hi, lo = s[np.arange(n), grade], s[np.arange(n), grade + 1]
        dhi, dlo = d[np.arange(n), grade], d[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        gz = -(dhi - dlo) / p / n
        gw = np.bincount(cols, values * gz[rows], n_words)
        gt = np.array([((dhi * (grade == j + 1) - dlo * (grade == j)) / p).sum() / n for j in range(grades - 1)])
        w = v - step_w * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step_w * l1, 0)
        t = np.maximum.accumulate(t - step_t * gt)
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, before, k = w + (k - 1) / after * (w - before), w, after
    return w, t


def train(bags: list[dict[str, int]], toxic: np.ndarray) -> Model:
    """From each row's vocabulary words and whether it is toxic."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Model({}, ())
    vocabulary = sorted({w for b in bags for w in b})
    place = {w: k for k, w in enumerate(vocabulary)}
    cells = [(r, place[w], 1 + np.log(n)) for r, b in enumerate(bags) for w, n in b.items()]
    rows, cols, values = (np.array(x) for x in zip(*cells, strict=True)) if cells else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    first, _ = cumulative_link(rows, cols, values, len(place), toxic, 2)
    marked = {vocabulary[k] for k in np.flatnonzero(first > MARKED)}
    uses = np.array([sum(n for w, n in b.items() if w in marked) for b in bags])
    grade = np.where(toxic == 1, 1 + sum((uses >= c).astype(int) for c in CUTS), 0)
    grades = int(grade.max()) + 1
    present = np.unique(grade)
    if len(present) < grades:  # a grade without rows has no threshold of its own
        grade, grades = np.searchsorted(present, grade), len(present)
    w, t = cumulative_link(rows, cols, values, len(place), grade, grades)
    return Model({vocabulary[k]: float(w[k]) for k in np.flatnonzero(w)}, tuple(map(float, t)))


def _bags(batches: Iterator[pa.RecordBatch], only: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        bags = [Counter(w for w in words_of(t) if w and (only is None or w in only)) for t in texts_of(b)]
        yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array([list(x) for x in bags], pa.list_(pa.string())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "counts"])


def vocabulary_of(sample: DataFrame, max_words: int = MAX_WORDS, least_g: float = LEAST_G) -> list[str]:
    """The words of sample(doc_id, toxic, text) whose documents differ most in toxicity from all."""
    schema = "doc_id long, toxic int, words array<string>, counts array<int>"
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    each = sample.mapInArrow(_bags, schema).select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where("n > 2")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    k, n_w = F.col("k"), F.col("n")
    rest_k, rest = toxic - k, n - n_w
    g = 2 * (part(k, n_w * toxic / n) + part(n_w - k, n_w * (n - toxic) / n) + part(rest_k, rest * toxic / n) + part(rest - rest_k, rest * (n - toxic) / n))
    return [r.word for r in each.select("word", g.alias("g")).where(F.col("g") >= least_g).orderBy(F.desc("g"), "word").limit(max_words).collect()]


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """A model of at most max_labels labelled rows, those first by a hash of their ids. Words are counted by Spark; of
    each sampled text only its vocabulary words reach the driver."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labels)
    )
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")
    only = set(vocabulary_of(sample))
    got = sample.mapInArrow(lambda x: _bags(x, only), "doc_id long, toxic int, words array<string>, counts array<int>")
    # of documents with equal ids each has all labels of the id, so the bound holds again here; a few words a row
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "words").limit(max_labels).collect()
    got.sort(key=lambda r: (r.doc_id, r.toxic, r.words))
    return train([dict(zip(r.words, r.counts, strict=True)) for r in got], np.array([r.toxic for r in got], int))


def grade_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            got = [shared.value.predict(t) for t in texts_of(b)]
            cells = ([x[0] for x in got], pa.float64()), ([x[1] for x in got], pa.int32()), ([x[2] for x in got], pa.float64()), ([int(x[2] >= 0.5) for x in got], pa.int32())
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in cells)], names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
