import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators.classify import classify, lens_matches, term_hits
from marginalia.operators.comparison import first_links, group_profiles, variation_merges
from marginalia.operators.terms import TermIndex


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_profiles_count_documents_once(spark):
    assigned = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (4, None), (5, 2)], "document_id long, group_id int")
    docs = spark.createDataFrame([(1, 2001, "A1"), (2, 2001, ""), (3, 1800, None), (4, 2002, "A1"), (5, None, "B1")], "id long, year int, stratum string")
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 12), (3, 10), (4, 10), (5, 99)], "document_id long, institution_id int")
    institutions = spark.createDataFrame([(10, "X", "public", 1), (11, "Y", "public", 2), (12, "Y", None, None)], "id int, name string, nature string, country_id int")
    countries = spark.createDataFrame([(1, "P", "south"), (2, "Q", "south")], "id int, name string, continent string")
    assert rows(group_profiles(assigned, docs, links, institutions, countries)) == sorted([
        (1, "group", None, 2), (2, "group", None, 2), (1, "country", "P", 1), (1, "country", "Q", 1), (1, "country", "not given", 1), (2, "country", "P", 1), (1, "continent", "south", 1), (1, "continent", "not given", 1),
        (2, "continent", "south", 1), (1, "institution", "X", 1), (1, "institution", "Y", 2), (2, "institution", "X", 1), (1, "nature", "public", 1), (1, "nature", "not given", 1), (2, "nature", "public", 1),
        (1, "stratum", "A1", 1), (1, "stratum", "none", 1), (2, "stratum", "none", 1), (2, "stratum", "B1", 1), (1, "year", "2001", 2),
    ], key=str)


@pytest.mark.parametrize("unique", [True, False])
def test_links_that_repeat_an_identity(spark, unique):
    rnd = random.Random(1)
    made = [(rnd.randrange(30), i if unique else rnd.randrange(9), rnd.randrange(4), rnd.randrange(3)) for i in range(300)]
    want = [r for r in made if not any(x[0] == r[0] and x[3] == r[3] and x[2] != r[2] and x[1] < r[1] for x in made)]
    got = first_links(spark.createDataFrame(made, "document_id long, link_id long, raw long, effective long")).select("document_id", "link_id", "raw", "effective")
    assert rows(got) == sorted(want, key=str)


def test_variations_go_by_the_first_link(spark):
    links = spark.createDataFrame([(2, 1, 7, "b"), (1, 9, 7, "a"), (1, 3, 7, "b"), (5, 1, 8, "a"), (5, 2, 9, "none"), (6, 1, 1, "a")], "document_id long, position int, id long, form string")
    forms = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("", 9)], "form string, id long")
    assert [r[1:] for r in rows(variation_merges(links, forms).orderBy("nr"))] == [(7, 2), (8, 1)]


# ---- terms ----

TEXTS = ["red bolt, red.", "bored", "", None, "straße rot", "a-b a_b 2red", "red", "x" * 1000 + " red " + "y" * 1000, "\U0001f600red\U0001f600", "infrared red٣"]
TERMS = ["red", "re", "ed", "bolt, red", "rot", "ß", "a-b", "a_b", "b", "none", "😀", "."]


@pytest.mark.parametrize("letters", [1, 7, 10_000])
def test_terms_in_blocks_of_any_size(spark, letters):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "document_id int, text string")
    index = TermIndex(spark.createDataFrame([(t,) for t in [*TERMS, "red", ""]], "term string"), max_letters=letters)
    assert len(index.blocks) == {1: len(TERMS), 10_000: 1}.get(letters, len(index.blocks))
    named = index.numbers()
    plain = {(i, t) for i, x in enumerate(TEXTS) for t in TERMS if t in (x or "")}
    assert {(r[0], r[1]) for r in index.search(docs, F.col("text")).join(named, "number").select("document_id", "term").collect()} == plain
    word = {(i, t) for i, x in enumerate(TEXTS) for t in TERMS if re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", x or "")}
    assert {(r[0], r[1]) for r in index.search(docs, F.col("text"), words=True).join(named, "number").select("document_id", "term").collect()} == word


def test_no_terms_no_texts(spark):
    docs = spark.createDataFrame([(1, "a")], "document_id int, text string")
    assert TermIndex(spark.createDataFrame([], "term string")).search(docs, F.col("text")).collect() == []
    assert TermIndex(spark.createDataFrame([("a",)], "term string")).search(docs.limit(0), F.col("text")).collect() == []


def test_many_terms_in_one_pass(spark):
    """10,000 rules: no join of rules and documents by what they hold."""
    rnd = random.Random(7)
    terms = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randrange(3, 9))) for _ in range(13_000)})[:10_000]
    rules = [(rnd.randrange(40), i, t) for i, t in enumerate(terms)]
    texts = [(i, 2000, " ".join("".join(rnd.choice("abcde") for _ in range(7)) for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(texts, "document_id int, year int, text string")
    frame = spark.createDataFrame(rules, "group_id int, position int, term string")
    got = term_hits(docs, frame)
    first = {}
    for i, _, text in texts:
        for group, position, term in rules:
            if term in text:
                first[i, group] = min(first.get((i, group), (position, term)), (position, term))
    assert rows(got) == sorted(((i, g, t) for (i, g), (_, t) in first.items()), key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    groups = spark.createDataFrame([(i, "normal", i) for i in range(40)], "id int, type string, position int")
    assert rows(classify(docs, groups, frame).where("group_id IS NOT NULL")) == rows(got)
    lenses = spark.createDataFrame([(f"l{g}", t) for g, _, t in rules], "lens string, term string")
    want = {}
    for i, _, text in texts:
        for word in set(text.split(" ")) & set(terms):
            for g in {g for g, _, t in rules if t == word}:
                want.setdefault(f"l{g}", set()).add(i)
    assert {r["lens"]: r["doc_count"] for r in lens_matches(docs, lenses).collect()} == {k: len(v) for k, v in want.items()}


# ---- edit distance ----


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_pairs_by_segments_are_all_pairs(spark, threshold):
    from marginalia.operators.similarity import edit_pairs

    rnd, texts = random.Random(11), ["a" * 17, "a" * 17 + "bcd", "", "x", "xy", "\U0001f600é" * 6, "\U0001f600é" * 5 + "é"]
    for _ in range(14):
        base = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 30)))
        for _ in range(4):
            other = list(base)
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(other) + 1)
                other[at : at + rnd.randrange(2)] = rnd.choice(["", "d", "ee"])
            texts.append("".join(other))
    made = [(block, head + t) for block, head in ((1, ""), (2, "one and the same start ")) for t in texts] + [(None, "aaa"), (1, None)]
    got = edit_pairs(spark.createDataFrame(made, "block int, text string"), threshold)
    want = {}
    for block, head in ((1, ""), (2, "one and the same start ")):
        own = sorted({head + t for t in texts}, key=lambda t: (-len(t), t))
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                score = 1 - _distance(x, y) / max(len(x), 1)
                if x and y and score >= threshold:
                    want[block, x, y] = round(score, 9)
    assert {(r["block"], r["text1"], r["text2"]): round(r["score"], 9) for r in got.collect()} == want and len(want) > 50


# ---- files ----


def test_groups_written_and_read_again(spark, tmp_path):
    from marginalia.sources.sinks import comparison_rows, group_rows, name_rows, safe_csv
    from marginalia.sources.vocabularies import read_groups

    lines = ["h" * 3 + ";" * 14, 'Alpha;normal;#111111;i;2;red bolt, blue;title;1999;2001;A1; B2;public;south;1; 2;"Silva, A; Souza";1', "=Beta;noise;;;1;x;;;;;;;;;0"]
    (tmp_path / "in.csv").write_text("\n".join(x if i != 1 else 'Alpha;normal;#111111;i;2;red bolt, blue;title;1999;2001;A1;public;south;1;"Silva, A; Souza";1' for i, x in enumerate(lines)))
    first = read_groups(spark, str(tmp_path / "in.csv"))
    safe_csv(group_rows(*first).coalesce(1), str(tmp_path / "out"))
    again = read_groups(spark, str(tmp_path / "out"))
    assert rows(again[0].drop("__at")) == rows(first[0].drop("__at")) and rows(again[1]) == rows(first[1]) and len(rows(first[1])) == 3
    stats = spark.createDataFrame([(2, 3, 7), (1, 1, 0)], "group_id int, doc_count long, citations long")
    groups = spark.createDataFrame([(1, "a", "normal"), (2, "b", "noise")], "id int, name string, type string")
    assert [tuple(r) for r in comparison_rows(stats, groups, 8).collect()] == [(1, "a", "normal", 1, "12.5", 0, "0.00"), (2, "b", "noise", 3, "37.5", 7, "2.33")]
    authors = spark.createDataFrame([(1, "Silva, A"), (2, "Souza")], "id long, name string")
    variants = spark.createDataFrame([(1, "silva a", "x", "d"), (1, "Silva, A", "x", "d"), (1, "A Silva", "x", "d"), (2, "souza", "x", "d")], "author_id long, original_name string, source string, created_at string")
    links = spark.createDataFrame([(1,), (1,)], "author_id long")
    assert [r[1] for r in name_rows(authors, variants, links).collect()] == ["A Silva", "silva a"]


@pytest.mark.parametrize("copies", [0, 40])
def test_closest_pairs_are_the_first_of_all(spark, copies):
    """Stopping at equal or very similar names leaves out nothing that belongs to the first pairs; whole when all are fewer."""
    from marginalia.operators.similarity import closest_pairs, similar_pairs

    rng = random.Random(4)
    names = ["anna maria gonzalez-" + "".join(rng.choice("abc") for _ in range(3)) for _ in range(60)] + ["anna maria gonzalez-aaa"] * copies
    rows = [(i, n, rng.choice(["x", "x", "y"]), rng.randint(0, 3)) for i, n in enumerate(names)]
    d = spark.createDataFrame(rows, "id long, name string, block string, n long")
    first = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("id1") < F.col("id2")))
    n = {r[0]: r[3] for r in rows}
    every = [(round(r.exact * 100, 1), *sorted((r.id1, r.id2), key=lambda i: (-n[i], i))) for r in similar_pairs(d.select("id", "name", "block"), F.col("block"), 0.85).collect()]
    every.sort(key=lambda x: (-x[0], x[1], x[2]))
    for limit in (3, 90, 10**6):
        got = [(r.similarity, r.keep, r.discard) for r in closest_pairs(d, first, 0.85, limit).collect()]
        assert got == every[:limit]


def test_profiles_in_more_partitions_than_the_session_has(spark, monkeypatch):
    """Many links go in more and smaller tasks, with the same counts."""
    from marginalia.operators import comparison

    assigned = spark.range(200).selectExpr("id AS document_id", "CAST(id % 3 AS INT) AS group_id")
    docs = spark.range(200).selectExpr("id", "CAST(2000 + id % 2 AS INT) AS year", "'' AS stratum")
    links = spark.range(1000).selectExpr("id % 200 AS document_id", "id % 7 AS institution_id")
    houses = spark.range(7).selectExpr("id", "concat('I', id) AS name", "CAST(NULL AS STRING) AS nature", "id % 2 AS country_id")
    places = spark.createDataFrame([(0, "A", "X")], "id long, name string, continent string")
    monkeypatch.setattr(comparison, "ROWS", 100)
    got = {(r.group_id, r.kind, r.label): r.doc_count for r in comparison.group_profiles(assigned, docs, links, houses, places).collect()}
    seen = {}
    for i in range(1000):
        d, h = i % 200, i % 7
        for kind, label in (("institution", f"I{h}"), ("nature", "not given"), ("country", "not given" if h % 2 else "A"), ("continent", "not given" if h % 2 else "X")):
            seen.setdefault((d % 3, kind, label), set()).add(d)
    for d in range(200):
        for kind, label in (("group", None), ("stratum", "none"), ("year", str(2000 + d % 2))):
            seen.setdefault((d % 3, kind, label), set()).add(d)
    assert got == {k: len(x) for k, x in seen.items()}


def test_report_of_links_that_are_counted(spark):
    """A row may stand for n links; the report and the totals are those of the single links."""
    from marginalia.operators.comparison import resolution_report

    one = spark.createDataFrame([("a", True)] * 3 + [("b", False)] * 2 + [("c", False)], "label string, resolved boolean")
    many = spark.createDataFrame([("a", True, 1), ("a", True, 2), ("b", False, 2), ("c", False, 1)], "label string, resolved boolean, n long")
    for single, counted in zip(resolution_report({"x": one, "y": many}), resolution_report({"x": many, "y": one}), strict=True):
        assert sorted(single.collect()) == sorted(counted.collect())
    got = {tuple(r) for r in resolution_report({"x": many})[0].collect()}
    assert got == {("x", True, "a", 3), ("x", False, "b", 2), ("x", False, "c", 1)}


def test_hits_are_not_dealt_by_term(spark):
    """Few terms hold most hits, so a shuffle by term would leave all of them to few tasks, however many there are."""
    docs = spark.range(50).selectExpr("id AS document_id", "1999 AS year", "concat('red ring ', id) AS text")
    rules = spark.createDataFrame([(1, 0, "red"), (2, 0, "ring"), (2, 1, "7")], "group_id int, position int, term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = term_hits(docs, rules)
        assert "hashpartitioning(number" not in hits._jdf.queryExecution().executedPlan().toString()
        assert {(r.group_id, r.term) for r in hits.collect()} == {(1, "red"), (2, "ring")} and hits.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
