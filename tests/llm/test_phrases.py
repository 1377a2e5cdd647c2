import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marginalia.llm import phrases
from marginalia.llm.common import Scratch
from marginalia.llm.phrases import OP12_SQL, collocations, counted, frequent_phrases, op12_phrases, spaced

KINDS = "doc_id long, text string, lang string"


def plain_counts(rows):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, total


def plain(rows, least, top=2000):
    f, total = plain_counts(rows)
    c = {k: n for k, n in f.items() if n >= least and " " in k[1]}
    by = {}
    for (lang, phrase), a in c.items():
        words, cuts = phrase.split(" "), []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        if any(x == lang and f" {phrase} " in f" {y} " and len(y.split(" ")) > len(words) and 100 * n >= 80 * a for (x, y), n in c.items()):
            continue
        score, _, left, right = min(cuts)
        by.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, found in by.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def made(seed, n, words, langs):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" if i % 2 else f"é{i}\x1c" for i in range(words)]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(vocabulary[: 1 + int(rnd.random() ** 2 * words)]) + rnd.choice(["  ", " ", " ", "\t", " ", ". ", "\n"]) for _ in range(rnd.randrange(40)))
        rows.append((i, text + rnd.choice(["", " red green blue", "\nto be or not to be"]), rnd.choice(langs)))
    return rows


@pytest.mark.parametrize("shards", [1, 3])
def test_against_plain_counts(spark, shards):
    rows = [*made(1, 250, 12, ["en", None, "und"]), (None, None, "en"), (1, "", None), (2, " . ,\t", "fr"), (2, "same same same", "fr"), (2, "same same same", "fr")]
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    got = sorted(map(tuple, collocations(docs, least=8, shards=shards).collect()))
    assert got == plain(rows, 8) and len(got) > 40
    if shards == 1:
        assert sorted(map(tuple, collocations(docs, least=8, top=5).collect())) == plain(rows, 8, 5)
        return
    with Scratch(spark) as keep:
        counts, totals = frequent_phrases(docs, keep, least=8, shards=shards)
        f, total = plain_counts(rows)
        assert {(r["lang"], r["phrase"]): r["n"] for r in counts.collect()} == {k: n for k, n in f.items() if n >= 8}
        assert {r["lang"]: r["n"] for r in totals.collect()} == {k: n for k, n in total.items() if n}


def test_long_phrases_that_wake_late(spark):
    rows = [(i, "rare pair here now" if i >= 60 else "rare x pair y here z now", "en") for i in range(75)] + [(100 + i, f"pad{i} w", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, KINDS).repartition(5)
    assert sorted(map(tuple, collocations(docs, least=15, shards=5).collect())) == plain(rows, 15)


def test_texts_cut_in_parts():
    rnd = random.Random(5)
    text = " ".join(rnd.choice(["a", "bb", "ccc", "long" * 9, "end.", "x\ny"]) for _ in range(700))
    bits = np.full(1 << 10, ~np.uint64(0))
    f, _ = plain_counts([(0, text, "en")])
    for size in (1, 7, 50, 10_000):
        got = Counter()
        for found, n in counted("en", spaced([text]), {2, 3, 4}, True, bits, bits, size):
            got.update(dict(zip([("en", x.decode()) for x in found.to_pylist()], n.tolist(), strict=True)))
        assert got == f


def test_the_sieve_is_blind_and_nothing_changes(spark, monkeypatch):
    """Every phrase passes: sums of the last scans still are the counts."""
    monkeypatch.setattr(phrases, "bit_tables", lambda reached, count: (np.full(1 << 10, ~np.uint64(0)),) * 2)
    rows = made(3, 120, 9, ["en"])
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, KINDS), least=8).collect())) == plain(rows, 8)


def test_no_rows_nothing_frequent_clashing_names(spark):
    assert collocations(spark.createDataFrame([], KINDS)).collect() == []
    assert collocations(spark.createDataFrame([(1, "one two three", "en")], KINDS)).collect() == []
    docs = spark.createDataFrame([(i, "to be or not", "en") for i in range(40)], KINDS).selectExpr("*", "1 AS shard", "2 AS phrase", "3 AS words", "4 AS n", "5 AS reached")
    assert [tuple(r) for r in collocations(docs).collect()] == plain([(i, "to be or not", "en") for i in range(40)], 30)


def test_query_and_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted(con.execute(OP12_SQL).fetchall())
    assert sorted(map(tuple, op12_phrases(spark, at).collect())) == want and want
    assert phrases.LEAST == 30
