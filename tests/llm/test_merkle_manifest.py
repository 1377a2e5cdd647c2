import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from marginalia.llm.merkle_manifest import OP13_SQL, merkle_manifest, op13_merkle_manifest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """(root, the path of each node) of a list."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            other = at[i] ^ 1
            path.append((other < at[i], nodes[other]) if other < len(nodes) else (False, ""))
            at[i] //= 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        by[lang].append((doc_id, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n + bad if bad else n, text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {x: plain_tree([r[1] for r in by[x]]) for x in langs}
    root, above = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above, strict=True):
        for (doc_id, one, seen), path in zip(by[x], trees[x][1], strict=True):
            node = seen
            for left, other in path + up:
                node = h(other, node) if left else h(node, other)
            out.append((doc_id, one, trees[x][0], root, h(*(o for _, o in path + up)), node, node == root))
    return sorted(out, key=str)


def tampered(c="n_chars"):
    return {c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col(c) + 1).otherwise(F.col(c))}


def got(spark, rows, **more):
    return sorted(map(tuple, merkle_manifest(spark.createDataFrame(rows, KINDS), seen=tampered(), **more).collect()), key=str)


def test_trees_of_all_shapes(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "é" * 3, "it", "s", None), (5, "é" * 3, "it", "s", None), (5, "other", "it", "s", 1), (-3, "x" * 300_000, "it", None, 9)]
    for lang, n in (("de", 1), ("en", 67), ("fr", 16), ("\U0001f600", 17), ("~", 2)):
        rows += [(i, f"{lang} {i}", lang, f"s{i % 3}", i) for i in range(n)]
    assert got(spark, rows, bits=2) == got(spark, rows) == plain(rows)


def test_one_row_one_language_no_rows(spark):
    one = [(3, "a", "en", "s", 1)]
    assert got(spark, one) == plain(one)
    same = [(i % 40, "a", "en", "s", 1) for i in range(100)]
    assert got(spark, same, bits=1) == plain(same)
    assert got(spark, []) == []


def test_clashing_names(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(9)]
    names = ("grp", "digest", "seen", "pos", "size", "tree", "part", "at", "tie", "block", "id", "leaf", "root")
    docs = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(7) for c in names})
    assert sorted(map(tuple, merkle_manifest(docs, seen=tampered(), bits=1).collect()), key=str) == plain(rows)


def test_query_and_sql(spark):
    at = "/root/testdata/sf0.001"
    query = sorted(map(tuple, op13_merkle_manifest(spark, at).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert query == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    assert sorted(con.execute(OP13_SQL).fetchall(), key=str) == query
    assert 0 < sum(not r[-1] for r in query) < len(query) / 3
