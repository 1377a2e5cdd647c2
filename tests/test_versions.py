import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators.identity import effective_authors
from marginalia.operators.upkeep import changed_sources, merge_all, refresh_effective
from marginalia.plans.corpus import Corpus
from marginalia.sources.versions import Conflict, ResultCache, VersionedTable, snapshot_id

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- snapshots and kept results ----


def test_snapshots_move_with_the_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "deep").mkdir(parents=True)
    (a / "deep" / "x").write_text("1")
    b.write_text("2")
    paths = [f"file://{a}", str(b)]
    first = snapshot_id(spark, paths)
    assert first == snapshot_id(spark, reversed(paths)) and snapshot_id(spark, [*paths, f"{tmp_path}/none"]) is None
    b.read_text()
    (tmp_path / "c").write_text("another file that the paths don't name")
    assert snapshot_id(spark, paths) == first
    (a / "deep" / "x").write_text("12")
    assert snapshot_id(spark, paths) != first


def test_changed_input_gives_new_rows_in_the_same_session(spark, tmp_path):
    from marginalia.plans.catalog import queries

    at = str(tmp_path / "sf")
    shutil.copytree(SF, at)
    run = lambda: queries()["annual_production"](spark, at).agg(F.sum("doc_count")).first()[0]
    before = run()
    opened = Corpus.of(spark, at)
    assert Corpus.of(spark, at) is opened and run() == before
    half = spark.read.parquet(f"{at}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    half.to_parquet(f"{at}/orders.parquet", coerce_timestamps="us")
    assert Corpus.of(spark, at) is not opened and run() < before
    assert opened._tables  # for those who still read them
    shutil.copy(f"{SF}/orders.parquet", f"{at}/orders.parquet")
    assert run() == before and not opened._tables


def test_a_query_is_made_anew_if_the_input_moves_meanwhile(spark, tmp_path):
    at, seen = str(tmp_path / "sf"), []
    shutil.copytree(SF, at)

    def make(c):
        seen.append(c)
        if len(seen) == 1:
            shutil.copy(f"{SF}/orders.parquet", f"{at}/orders.parquet")
        return c.documents

    Corpus.answer(spark, at, make)
    assert len(seen) == 2 and seen[0] is not seen[1]


class Version:
    def __init__(self, at="1"):
        self.at = at

    def __call__(self):
        return self.at


def test_results_are_kept_by_project_name_parameters_and_version(spark, tmp_path):
    version, calls = Version(), []
    cache = ResultCache(spark, version, f"file://{tmp_path}")

    def get(*key, then=None):
        def compute():
            calls.append(key)
            if then:
                version.at = then
            return spark.createDataFrame([(len(calls), None)], "n int, x string")

        return cache.get(*key, compute).first()[0]

    assert [get(1, "a/b", {"k": 1, "l": [2]}), get(1, "a/b", {"l": [2], "k": 1})] == [1, 1]
    assert [get(2, "a/b", {"k": 1}), get(1, "b", {"k": 1}), get(1, "a/b", {"k": 2})] == [2, 3, 4]
    version.at = "2"
    assert [get(1, "b", {"k": 1}), get(1, "b", {"k": 1})] == [5, 5]
    get(1, "c", {}, then="3")  # the data moves while it is made: not kept
    assert len(calls) == 6 and get(1, "c", {}) == 7 and get(1, "c", {}) == 7
    version.at = None
    assert get(1, "c", {}) != get(1, "c", {})
    version.at = "3"
    assert ResultCache(spark, version, f"file://{tmp_path}").get(1, "c", {}, lambda: 1 / 0).first()[0] == 7  # another session's


def test_results_expire_are_bounded_and_never_fail(spark, tmp_path):
    cache = ResultCache(spark, Version(), f"file://{tmp_path}")
    one = lambda n: lambda: spark.createDataFrame([(n,)], "n int")
    cache.TTL = 2
    cache.get(1, "x", {}, one(1))
    time.sleep(3)
    assert cache.get(1, "x", {}, one(2)).first()[0] == 2
    time.sleep(3)
    assert cache.prune() >= 1
    cache.MAX_BYTES = 10
    cache.get(1, "y", {}, one(3))
    assert cache.get(1, "y", {}, one(4)).first()[0] == 4
    closed = ResultCache(spark, Version(), "file:///proc/nowhere")
    assert closed.get(1, "x", {}, one(5)).first()[0] == 5


# ---- stored tables ----


def made(spark, tmp_path, n=200, buckets=8):
    frame = spark.range(n).select("id", (F.col("id") % 7).alias("kind"), F.lit("old").alias("text"))
    return VersionedTable.create(frame, f"file://{tmp_path}/t", ["id"], buckets)


def test_upsert_replace_delete_against_plain_rows(spark, tmp_path):
    table, rnd = made(spark, tmp_path), random.Random(2)
    want = {i: (i, i % 7, "old") for i in range(200)}
    for step in range(3):
        new = [(rnd.randrange(260) if i else None, step, f"s{step} {i}") for i in range(9)]
        table.upsert(spark.createDataFrame(new, "id long, kind long, text string"), F.col("text"))
        for x in sorted(new, key=lambda x: x[2], reverse=True):
            want[x[0]] = x
        gone = [rnd.randrange(260) for _ in range(5)]
        table.delete(spark.createDataFrame([(x,) for x in gone], "id long"))
        for x in gone:
            want.pop(x, None)
        owners, links = [1, 2, None, 300 + step], [(1, 9, "a"), (1, 9, "b"), (5, 9, "not asked for"), (300 + step, 9, "c")]
        table.replace(spark.createDataFrame([(x,) for x in owners], "id long"), spark.createDataFrame(links, "id long, kind long, text string"))
        for x in owners:
            want.pop(x, None)
        got = rows(table.read())
        assert got == sorted([*want.values(), *(x for x in links if x[0] in owners)], key=str)
        table.delete(spark.createDataFrame([(1,), (300 + step,)], "id long"))
    assert table.version() == 13


def test_only_touched_buckets_are_written_and_old_versions_stay(spark, tmp_path):
    table = made(spark, tmp_path)
    first = table.head()["paths"]
    before = table.read()
    table.upsert(spark.createDataFrame([(3, 0, "new")], "id long, kind long, text string"), F.col("text"))
    second = table.head()["paths"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert before.where("text = 'new'").isEmpty() and rows(table.read(1)) == rows(before)
    assert rows(table.read().where("id = 3")) == [(3, 0, "new")]
    assert table.vacuum(keep=2) == 0 and table.vacuum(keep=1) == 1
    assert table.read().count() == 200


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    table = made(spark, tmp_path)
    before, files = rows(table.read()), set((tmp_path / "t" / "data").iterdir())
    with pytest.raises(Exception, match="no luck"):
        table.rewrite([1, 2], lambda old: old.withColumn("kind", F.when(F.col("id") > 100, F.raise_error(F.lit("no luck")).cast("long")).otherwise(0)))
    assert table.version() == 1 and rows(table.read()) == before and set((tmp_path / "t" / "data").iterdir()) == files and not table.pending()


def test_of_two_commits_upon_one_version_the_second_fails(spark, tmp_path):
    table = made(spark, tmp_path)
    one = lambda text: spark.createDataFrame([(3, 0, text)], "id long, kind long, text string")

    def change(old):
        assert table.pending()
        if table.version() == 1:
            VersionedTable(spark, table.folder).upsert(one("first"), F.col("text"))
        return old.where("id <> 3").unionByName(one("second"))

    with pytest.raises(Conflict):
        table.rewrite(table.touched(one("x")), change)
    assert table.version() == 2 and rows(table.read().where("id = 3")) == [(3, 0, "first")]


def test_an_empty_table(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], "id long, text string"), f"file://{tmp_path}/e", ["id"])
    assert table.read().collect() == [] and table.upsert(spark.createDataFrame([], "id long, text string"), F.col("text")) == 1
    table.upsert(spark.createDataFrame([(1, "a")], "id long, text string"), F.col("text"))
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert table.read().collect() == [] and table.version() == 3


# ---- effective ids ----


def test_refreshed_effective_ids_equal_the_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, i % 3 + 1) for i in range(60)], "id long, project_id int")
    projects = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, owner_id int")
    links = spark.createDataFrame([(rnd.randrange(60), rnd.randrange(40), i) for i in range(400)], "document_id long, author_id long, position int")
    layers = [("project", 1), ("project", 2), ("user", 0), ("user", 1), ("global", 0)]
    mapping = lambda m: spark.createDataFrame([("author", s, i, a, b) for (s, i, a), b in m.items()], "entity_type string, scope string, scope_id int, source_id long, target_id long")
    state = {(*rnd.choice(layers), rnd.randrange(40)): rnd.randrange(40) for _ in range(30)}
    table = VersionedTable.create(effective_authors(links, docs, projects, mapping(state)), f"file://{tmp_path}/links", ["author_id"], 16)
    for _ in range(4):
        after = dict(state)
        for k in rnd.sample(sorted(after), 2):
            after.pop(k) if rnd.random() < 0.5 else after.update({k: rnd.randrange(40)})
        after[(*rnd.choice(layers), rnd.randrange(40))] = rnd.randrange(40)
        changed = changed_sources(mapping(state), mapping(after), "author")
        before = table.head()["paths"]
        refresh_effective(table, changed, lambda rows: effective_authors(rows, docs, projects, mapping(after)), "author")
        moved = {int(b) for b, p in table.head()["paths"].items() if p != before.get(b)}
        assert moved <= set(table.touched(changed.toDF("author_id"))) and len(moved) < 16
        assert rows(table.read().select("document_id", "author_id", "position", "author")) == rows(effective_authors(links, docs, projects, mapping(after)))
        state = after
    at = table.version()
    assert refresh_effective(table, changed, lambda rows: effective_authors(rows, docs, projects, mapping(state)), "author") == at


def one_by_one(start, merges):
    at, told = dict(start), []
    for nr, b, a in sorted(merges):
        final = at.get(a, a)
        if a == b:
            told.append((nr, "self", final))
        elif final == b:
            told.append((nr, "loop", final))
        elif b in at:
            told.append((nr, "noop" if at[b] == final else "elsewhere", final))
        else:
            at = {x: final if y == b else y for x, y in at.items()} | {b: final}
            told.append((nr, "merged", final))
    return at, told


KINDS = "entity_type string, scope string, scope_id int, source_id long, target_id long"


@pytest.mark.parametrize("seed", range(4))
def test_merges_in_bulk_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    n = [6, 12, 40, 200][seed]
    start = {n + i: rnd.randrange(n // 2) for i in range(n // 4)}
    merges = [(i, rnd.randrange(n + n // 4), rnd.randrange(n + n // 4)) for i in range(n * 2)]
    other = [("author", "user", 1, 3, 4), ("keyword", "global", 0, 3, 4)]
    mapping = spark.createDataFrame([*other, *(("author", "global", 0, a, b) for a, b in start.items())], KINDS)
    got, told = merge_all(mapping, spark.createDataFrame(merges, "nr long, source_id long, target_id long"), "author", "global", 0)
    at, want = one_by_one(start, merges)
    assert rows(told) == sorted(want, key=str)
    assert rows(got) == sorted([*other, *(("author", "global", 0, a, b) for a, b in at.items())], key=str)


def test_a_long_chain_of_merges(spark):
    n = 3000
    chain = [(i, i, i + 1) for i in range(n)]
    got, told = merge_all(spark.createDataFrame([], KINDS), spark.createDataFrame(chain + [(n, n, 0)], "nr long, source_id long, target_id long"), "author", "global", 0)
    assert got.where(f"target_id = {n}").count() == n == got.count()
    assert rows(told.where("outcome <> 'merged'")) == [(n, "loop", n)]
