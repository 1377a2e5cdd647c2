import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.importing import identities, import_outcomes
from marginalia.operators.networks import label_rounds
from marginalia.operators.similarity import similar_text
from marginalia.streaming.ingest import ImportState, event_sessions, import_with_state


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, n=120, seed=1):
    rnd = random.Random(seed)
    records = [(i, rnd.choice([None, None, f"10.1/{rnd.randrange(12)}"]), rnd.choice(["a", "b"]), rnd.choice([None, f"x{rnd.randrange(20)}"]), rnd.choice([None, f"Title {rnd.randrange(9)}", f"title  {rnd.randrange(9)}"]), rnd.choice([None, 2000, 2001]), rnd.random() < 0.4) for i in range(n)]
    return identities(spark.createDataFrame(records, "id long, doi string, source string, external_id string, title string, year int, strict boolean"))


@pytest.mark.parametrize("cuts", [(20, 120), (20, 21, 60, 120)])
def test_any_split_into_batches_gives_the_same_outcomes(spark, tmp_path, cuts):
    every = made(spark).cache()
    known = every.where("id < 20").withColumn("own", F.col("id") % 2 == 0)
    want = rows(import_outcomes(every.where("id >= 20"), known))
    state = ImportState(spark, f"file://{tmp_path}/s", known, 4)
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = every.where(F.col("id").between(a, b - 1))
        first = rows(state.step(part, batch))
        if batch == 0:
            assert rows(ImportState(spark, f"file://{tmp_path}/s").step(part, batch)) == first  # after a failure
    assert rows(state.outcomes(spark)) == want


def test_a_stream_of_files(spark, tmp_path):
    every = made(spark, 60, 2)
    for i, (a, b) in enumerate(((0, 30), (30, 60))):
        every.where(F.col("id").between(a, b - 1)).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
        stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        import_with_state(stream, f"file://{tmp_path}/s", str(tmp_path / "check")).awaitTermination()
    assert rows(ImportState(spark, f"file://{tmp_path}/s").outcomes(spark)) == rows(import_outcomes(every))


def test_sessions(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:29:00", 2.0), (1, "2024-01-01 01:10:00", 4.0), (2, "2024-01-01 00:10:00", 8.0)], "user_id long, ts string, value double")
    got = event_sessions(events).select("user_id", F.date_format("start", "HH:mm"), "n", "total")
    assert rows(got) == [(1, "00:00", 2, 3.0), (1, "01:10", 1, 4.0), (2, "00:10", 1, 8.0)]


def test_labels_of_a_plain_synchronous_version(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(1, 5)) for _ in range(90)] + [(100, i, 1) for i in range(40)]
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(6):
        after = {}
        for n, peers in near.items():
            sums = {}
            for m, w in peers:
                sums[label[m]] = sums.get(label[m], 0) + w
            after[n] = max(sums, key=lambda x: (sums[x], x == label[n], -x))
        if after == label:
            break
        label = after
    assert rows(label_rounds(spark.createDataFrame(edges, "source long, target long, weight long"), rounds=6)) == sorted(label.items(), key=str)
    assert label_rounds(spark.createDataFrame([], "source long, target long, weight long")).collect() == []


def plain_similar_text(a, b):
    best, at, bt = 0, 0, 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best:
                best, at, bt = k, i, j
    return best and best + plain_similar_text(a[:at], b[:bt]) + plain_similar_text(a[at + best :], b[bt + best :])


def test_common_runs():
    rnd = random.Random(3)
    for n in (0, 1, 5, 30, 200):
        for letters in ("ab", "abcdefgh é"):
            for _ in range(4 if n < 200 else 1):
                a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(n + 1))) for _ in range(2))
                assert similar_text(a, b) == plain_similar_text(a, b)
