"""Merkle manifest of a dataset: a digest of every row, a root for the whole, and a proof for each row.

Rows are hashed where they lie; only digests travel. The rows of a group (a language, however large) are placed by one
range sort and counts per partition, then reduced in superblocks of 2**`bits` consecutive nodes, which are reduced again
until one node is left of each group; groups form a tree above, in order, the same way. On the way down leaves and the
outer nodes that their superblock needs are cogrouped: one pandas call finishes the block's reduction, joins the inner and
outer part of each proof and folds the digest of the row as it is seen now up to the root. No task gets more than a block.

Defined results: a null field is `-`; a null group comes first, a null id first in its group; rows of equal id stand in
order of their digests, equal rows one beside the other; of an empty table no rows come back; other columns are ignored.
Very long texts are hashed by Spark and never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12  # of the leaves' numbers within a superblock
NODE = "tree long, pos long, digest string, size long"
PATH = "tree long, pos long, subroot string, path array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else its length in bytes, `:` and itself."""
    cells = []
    for v in values:
        v = v.cast("string")
        cells.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*cells), 256)


def placed(rows: DataFrame, order: list[str], keep: Scratch) -> DataFrame:
    """rows, which have a column `grp`, with their place `pos` and the group's `size`; groups and rows in ascending order.

    Equal rows are parted too: their place in the input decides among them.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["grp", *order, "tie"]
    rows = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("part", F.shiftrightunsigned("at", 33))
    parts = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))
    got = rows.join(parts, rows["grp"].eqNullSafe(parts["g"]) & (rows["part"] == parts["p"]))
    return got.withColumn("pos", F.col("at") + F.col("shift")).drop("g", "p", "part", "at", "shift")


def reduced(nodes: list[str], size: int, bits: int) -> list[list[str]]:
    """The levels of a block of a tree of `size` nodes, its own nodes first: up to its one node at the level `bits`, or to
    the tree's last one."""
    levels = [nodes]
    while size > 1 and len(levels) <= bits:
        last, size = levels[-1], (size + 1) // 2
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """What the node i of a block needs on its way up: L or R and the digest on that side, or `-` where it is alone."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append("-" if other >= len(level) else ("L" if other < i else "R") + level[other])
        i >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    for step in path:
        node = digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
    return node


def climb(nodes: DataFrame, bits: int, keep: Scratch) -> list[DataFrame]:
    """Tables of (tree, pos, digest, size): the nodes, the nodes of their superblocks, and so on. A tree ends where its size is 1."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        top = reduced(rows["digest"].tolist(), size, bits)[-1][0]
        return pd.DataFrame({"tree": [int(rows["tree"].iloc[0])], "pos": [int(rows["pos"].iloc[0]) >> bits], "digest": [top], "size": [-(-size >> bits)]})

    heights = [nodes.select("tree", "pos", "digest", "size")]
    while not (more := heights[-1].where("size > 1")).isEmpty():
        by = F.shiftright("pos", bits).alias("block")
        heights.append(keep(more.groupBy("tree", by).applyInPandas(block, NODE), "merkle-nodes"))
    return heights


def descend(heights: list[DataFrame], tops: DataFrame, bits: int, leaves: DataFrame, finish, schema: str, keep: Scratch) -> DataFrame:
    """Give every node of the lowest height its whole path. tops(tree, subroot, path) is what stands above each tree's last
    node; finish(leaves of a block, levels, subroot, outer path) gives the result's rows."""

    def inner(rows: pd.DataFrame, levels: list[list[str]], subroot: str, outer: list[str]) -> pd.DataFrame:
        paths = [siblings(levels, i) + outer for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "subroot": subroot, "path": paths})

    def joined(each):
        def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            if len(outer) != 1:
                raise ValueError(f"a block has {len(outer)} outer paths")
            rows = rows.sort_values("pos").reset_index(drop=True)
            levels = reduced(rows["digest"].tolist(), int(rows["size"].iloc[0]), bits)
            return each(rows, levels, outer["subroot"].iloc[0], list(outer["path"].iloc[0]))

        return run

    below: DataFrame | None = None
    for h in reversed(range(len(heights))):
        last, nodes = h == 0, leaves if h == 0 else heights[h]
        outer = heights[h].where("size = 1").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
        if below is not None:
            outer = outer.union(below.select("tree", F.col("pos").alias("block"), "subroot", "path"))
        outer = outer.toDF("of_tree", "of_block", "subroot", "path")  # other names: both sides may come from one table
        blocks = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block").cogroup(outer.groupBy("of_tree", "of_block"))
        below = blocks.applyInPandas(joined(finish if last else inner), schema if last else PATH)
        if not last:
            below = keep(below, "merkle-paths")
    return below


RESULT = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def merkle_manifest(docs: DataFrame, order: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, seen: Mapping[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """For each row its id, leaf, subroot, root and the digest of its proof; folded_root is made from the row as it is seen
    now (`seen`: other values for some fields), the original siblings and nothing else, verified whether that is the root."""
    seen = seen or {}
    # the name of the id survives whatever the other columns are called
    rows = docs.select(F.col(order).alias("id"), F.col(group).cast("string").alias("grp"), row_digest([F.col(f) for f in fields]).alias("digest"), row_digest([seen.get(f, F.col(f)) for f in fields]).alias("seen"))
    rows = rows.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen")))
    kind = docs.schema[order].dataType
    with Scratch(docs.sparkSession) as keep:
        rows = placed(keep(rows, "merkle-leaves"), ["id", "digest", "seen"], keep)
        rows = keep(rows, "merkle-placed")
        groups = rows.where("pos = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("name"))
        groups = keep(placed(groups, ["name"], keep).select(F.col("pos").alias("tree"), "name", F.col("size").alias("trees")), "merkle-groups")
        leaves = rows.join(groups, rows["grp"].eqNullSafe(groups["name"])).select("tree", "pos", "size", "digest", "seen", F.col("id").cast("string").alias("id"))  # pandas makes floats of longs with nulls
        leaves = keep(leaves, "merkle-numbered")
        heights = climb(leaves, bits, keep)
        subroots = None
        for h in heights:
            top = h.where("size = 1").select("tree", "digest")
            subroots = top if subroots is None else subroots.union(top)
        subroots = keep(subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.col("trees").alias("size")), "merkle-subroots")
        upper = climb(subroots, bits, keep)
        root = upper[-1].where("size = 1").first()
        root = root and root["digest"]

        def above(part: pd.DataFrame, levels: list[list[str]], _: str, outer: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"tree": part["pos"], "subroot": part["digest"], "path": [siblings(levels, i) + outer for i in range(len(part))]})

        spark = docs.sparkSession
        crown = spark.range(1).select(F.col("id").alias("tree"), F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("path"))
        tops = keep(descend(upper, crown, bits, subroots, above, "tree long, subroot string, path array<string>", keep), "merkle-tops")

        def finish(part: pd.DataFrame, levels: list[list[str]], subroot: str, outer: list[str]) -> pd.DataFrame:
            proofs, roots, folded = [], [], {}
            for i, (leaf, now) in enumerate(zip(part["digest"], part["seen"], strict=True)):
                path = siblings(levels, i)
                proofs.append(digest(*(x[1:] for x in path + outer)))
                node = fold(now if isinstance(now, str) else leaf, path)
                if node not in folded:  # nearly all rows of a block arrive at its one node
                    folded[node] = fold(node, outer)
                roots.append(folded[node])
            return pd.DataFrame({"id": part["id"], "leaf": part["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": roots, "verified": [x == root for x in roots]})

        out = descend(heights, tops, bits, leaves, finish, RESULT, keep)
        return written(out.select(F.col("id").cast(kind).alias(order), *(c for c in out.columns if c != "id")), "merkle-manifest")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
    return merkle_manifest(table(spark, sf_dir, "documents"), seen={"n_chars": F.when(suspect, more).otherwise(F.col("n_chars").cast("string"))})


def _levels(name: str, rows: str) -> str:
    """SQL: the nodes (tree, level, pos, digest, n) above rows (tree, pos, digest, n)."""
    return f"""{name}(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, digest, n FROM {rows}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n
)"""


def _cells(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(octet_length(encode(({v})::VARCHAR)), ':', {v}) END" for v in values) + "))"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))))"""

OP13_SQL = f"""
WITH RECURSIVE marked AS (
  SELECT *, doc_id IS NOT NULL AND {_CRC} % 7 = 0 AS bad FROM documents
), hashed AS (
  SELECT doc_id, lang, {_cells("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_cells("doc_id", "source", "lang", "n_chars + bad::INT", "text")} AS seen FROM marked
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM hashed)
), leaves AS (
  SELECT row_number() OVER () AS id, tree, doc_id, leaf, seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang
), {_levels("low", "leaves")}, tops AS (
  SELECT 0 AS tree, low.tree AS pos, digest, trees AS n, level AS height FROM low JOIN langs USING (tree) WHERE n = 1
), {_levels("high", "tops")}, places AS (
  SELECT l.id, v.level AS k, l.pos >> v.level AS pos, low.digest, low.pos AS other FROM leaves l JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) v ON v.tree = l.tree
  LEFT JOIN low ON low.tree = l.tree AND low.level = v.level AND low.pos = xor(l.pos >> v.level, 1)
), places_above AS (
  SELECT l.id, t.height + v.level AS k, t.pos >> v.level AS pos, high.digest, high.pos AS other FROM leaves l JOIN tops t ON t.pos = l.tree CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) v
  LEFT JOIN high ON high.level = v.level AND high.pos = xor(t.pos >> v.level, 1)
), steps AS (
  SELECT * REPLACE (coalesce(digest, '') AS digest) FROM (SELECT id, k, pos, digest, other FROM places UNION ALL SELECT id, k, pos, digest, other FROM places_above)
), folded(id, k, digest) AS (
  SELECT id, 0, seen FROM leaves
  UNION ALL
  SELECT id, k + 1, sha256(CASE WHEN s.other < s.pos THEN s.digest || f.digest ELSE f.digest || s.digest END) FROM folded f JOIN steps s USING (id, k)
), proofs AS (
  SELECT id, sha256(string_agg(digest, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY id
)
SELECT doc_id, leaf, t.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN tops t ON t.pos = l.tree LEFT JOIN proofs USING (id) JOIN (SELECT id, arg_max(digest, k) AS folded_root FROM folded GROUP BY id) USING (id)
CROSS JOIN (SELECT digest AS root FROM high WHERE n = 1)
"""
