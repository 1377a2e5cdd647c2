"""URL rules, WARC records and the pipeline."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import queries, url_rules, warc_store
from marginalia.llm.url_rules import Rule, Sweep, apply_rules, host_key
from tests.conftest import SF


def brute_rule(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and host]
    return max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)


def test_sweep_against_all_rules():
    rng = random.Random(1)
    labels = ["a", "b", "com", "org", "x-y", "é", "a1"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = [Rule("block", host(rng.randint(1, 3)), rng.choice(["", "/", "/a", "/a/b"])) for _ in range(60)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    pages = [(host(rng.randint(1, 4)), rng.choice(["", "/", "/a/b/c", "/b", "/ab"])) for _ in range(3000)] + [("", "/a")]
    sweep = Sweep(rules)
    for key, h, p in sorted((host_key(h), h, p) for h, p in pages):
        sweep.move(key)
        got, want = sweep.best(p), brute_rule(rules, h, p)
        assert (got and got[1:]) == (want and want[1:])


def test_rules_in_blocks_and_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7x?y#z"), (3, "http://example.com/en/8"), (None, "http://com/en/"), (4, "x://com"), (5, "http://xcom/en/"), (6, "http://a.com?/en/"), (7, "http://é.com/en/\nb")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("rule", F.lit("r"))
    want = sorted([("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("com", "", None, "allow"), ("xcom", "/en/", None, "allow"), ("a.com", "", None, "allow"), ("é.com", "/en/\nb", "com/en/", "block")], key=str)
    for block in (2, 100):
        got = apply_rules(d, url_rules.rule_table(spark, url_rules.RULES), block=block).collect()
        assert sorted(((r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want
    assert apply_rules(d.limit(0), url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    assert {r.verdict for r in apply_rules(d, url_rules.rule_table(spark, [])).collect()} == {"allow"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_warc_odd_rows(spark):
    big, small = "x" * 200, "y"
    rows = [(5, "u", big), (2, "u\nv", big), (2, "w", big), (9, None, big), (None, "n", big), (7, "u", small), (8, "u", small), (10, "u", None), (11, "u", ""), (12, "u", "é\r\n\r\n" * 60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    headers, payloads = warc_store.write_archive(d)
    assert payloads.count() == 4
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc_store.read_archive(headers, payloads).collect()), key=repr)
    n = len(("é\r\n\r\n" * 60).encode())
    assert got == sorted([(5, "revisit", 2, 200), (2, "response", None, 200), (2, "response", None, 200), (9, "revisit", 2, 200), (None, "revisit", 2, 200), (7, "response", None, 1), (8, "response", None, 1), (10, "response", None, 0), (11, "response", None, 0), (12, "response", None, n)], key=repr)
    assert warc_store.read_archive(*warc_store.write_archive(d.limit(0))).count() == 0


def test_warc_damage():
    digest = hashlib.sha256(b"abc").hexdigest()
    data = warc_store.record_head(1, "u", "response", digest, 3, None) + b"abc\r\n\r\n"
    assert warc_store.parse_record(data)[2] == b"abc"
    with pytest.raises(ValueError):
        warc_store.parse_record(data[:-1])


def test_pipeline(spark):
    """Every stage keeps the columns, its decisions hold, and the last one is the library's encoding."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert new.columns == columns and new.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        kept.append(new.count())
        docs = new
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    assert not any(t in r.text for t in items for r in rows) and len({r.text for r in rows}) == len(rows)
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert got == {r.doc_id: len(lib.encode(r.text)) for r in rows}


def test_pipeline_stages_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_with_capitals_or_without_a_host(spark):
    d = spark.createDataFrame([(1, "http://A.Example.com/x/1"), (2, "http://b.org/x/1")], "page_id long, url string")
    got = apply_rules(d, url_rules.rule_table(spark, [Rule("block", "EXAMPLE.com", "/x/")])).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.com/x/", "block"), (None, "allow")]
    with pytest.raises(ValueError, match="empty host"):
        apply_rules(d, url_rules.rule_table(spark, [Rule("block", "", "/x/")]))


def test_rules_of_the_contract(spark):
    """Each rule's word, on a page where that rule is the longest."""
    rows = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://b.example.net/de/8", "http://example.net/de/9", "http://a.org/es/"]
    d = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = apply_rules(d, url_rules.rule_table(spark, url_rules.RULES)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
