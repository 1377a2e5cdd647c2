"""Upkeep of derived identities: groupings in bulk, and effective ids of the links that a change touches alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.sources.store import stored
from marginalia.sources.versions import VersionedTable

LAYER = ["entity_type", "scope", "scope_id"]


def changed_sources(before: DataFrame, after: DataFrame, entity: str) -> DataFrame:
    """source_id of all mapping rows of an entity that came, went or got another target."""
    of = lambda m: m.where(F.col("entity_type") == entity).select("scope", "scope_id", "source_id", "target_id")
    rows = of(before).withColumn("n", F.lit(-1)).union(of(after).withColumn("n", F.lit(1)))
    return rows.groupBy("scope", "scope_id", "source_id", "target_id").agg(F.sum("n").alias("n")).where("n <> 0").select("source_id").distinct()


def refresh_effective(table: VersionedTable, changed: DataFrame, effective: Callable[[DataFrame], DataFrame], column: str) -> int:
    """Bring the column of a table of links up to date after the mappings of changed(source id) have changed; the table's
    version afterwards.

    The table's bucket key is the raw id. effective(links) gives links with the column made anew. Only buckets of changed ids
    are read, only links of changed ids are made anew, and only buckets are written in which a value differs; nothing
    is, if none does.
    """
    head = table.head()
    (key,) = head["keys"]
    ids = changed.toDF(key).distinct()
    near = table.touched(ids, head)
    if not near:
        return head["version"]
    links = table._rows(head, near)
    columns = links.columns

    def anew(rows: DataFrame) -> DataFrame:
        return effective(rows.join(ids, key, "left_semi").select(*(c for c in columns if c != column)))

    rest = [c for c in columns if c != column]
    old = links.join(ids, key, "left_semi").groupBy(*rest, column).count()
    new = stored(anew(links).groupBy(*rest, column).count(), "effective")
    differ = new.exceptAll(old.select(*new.columns))
    buckets = table.touched(differ, head)
    return table.rewrite(buckets, lambda rows: rows.join(ids, key, "left_anti").select(*columns).unionByName(anew(rows).select(*columns)), head)


# ---- groupings in bulk ----


def jumps(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """edges(source, target, nr), one a source -> tables of (source, target, nr) where target is 1, 2, 4 ... steps on, and nr the
    greatest on the way; and, if there are loops, their closing edges (source): of each loop that with the greatest nr."""
    out, now = [], edges
    rounds = edges.count().bit_length()
    for _ in range(rounds):
        out.append(now)
        on = now.toDF("s", "t", "n")
        far = stored(now.join(on, now["target"] == on["s"]).select("source", F.col("t").alias("target"), F.greatest("nr", "n").alias("nr")), "jumps")
        if far.isEmpty():
            return out, None
        now = far
    # after more steps than there are edges: all who still get somewhere get into a loop, and into every part of it
    inside = now.select("target").distinct().toDF("source")
    at = now.join(inside, "source").select("source", "nr")
    return out, edges.join(at, ["source", "nr"], "left_semi").select("source", "nr")


def roots(at: DataFrame, steps: list[DataFrame], before: Column | None = None) -> DataFrame:
    """at(node, …) with the node's root: as far as edges go, or as far as all are earlier than `before`."""
    out = at.withColumn("root", F.col("node"))
    for step in reversed(steps):
        on = step.toDF("s", "t", "n")
        hit = (F.col("root") == on["s"]) & (F.col("n") < before if before is not None else F.lit(True))
        out = out.join(on, hit, "left").withColumn("root", F.coalesce("t", "root")).drop("s", "t", "n")
    return out


def merge_all(mapping: DataFrame, merges: DataFrame, entity: str, scope: str, scope_id: int) -> tuple[DataFrame, DataFrame]:
    """(mapping, outcomes) after merges(nr, source_id, target_id), as if done one by one in the order of nr.

    outcomes(nr, outcome, target_id): merged, or noop (grouped there already), or refused as self, loop (the target is grouped in
    the source) or elsewhere (the source is grouped in another target); target_id is the target's own target at that time.

    The first merge of each source that is not refused is an edge; sources point at targets by pointer jumping, in as many
    rounds as the logarithm of the longest chain. Where edges make a loop, its last one is refused, as when done one by one, and
    the next merge of its source takes its place. What a later merge of a grouped source meets is looked up by the same jumps, with
    the edges before it alone.
    """
    here = (F.col("entity_type") == entity) & (F.col("scope") == scope) & (F.col("scope_id") == scope_id)
    old = mapping.where(here).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit(-1).cast("long").alias("nr"))
    every = stored(merges.select(F.col("source_id").cast("long").alias("source"), F.col("target_id").cast("long").alias("target"), F.col("nr").cast("long").alias("nr")), "merges")
    open_ = every.where("source <> target").unionByName(old.select(*(F.col(c).cast("long").alias(c) for c in ("source", "target", "nr"))))
    refused = None
    while True:
        left = open_ if refused is None else open_.join(refused, ["source", "nr"], "left_anti")
        edges = stored(left.groupBy("source").agg(F.min(F.struct("nr", "target")).alias("e")).select("source", "e.target", "e.nr"), "edges")
        steps, loops = jumps(edges)
        if loops is None:
            break
        refused = stored(loops if refused is None else refused.union(loops), "loops")
    final = roots(edges.select(F.col("source").alias("node")), steps).select(F.col("node").alias("source_id"), F.col("root").alias("target_id"))
    new = final.select(F.lit(entity).alias("entity_type"), F.lit(scope).alias("scope"), F.lit(scope_id).alias("scope_id"), "source_id", "target_id")
    kept = mapping.where(~here).unionByName(new.select(*(F.col(c).cast(mapping.schema[c].dataType).alias(c) for c in mapping.columns if c in new.columns)), allowMissingColumns=True)

    then = roots(every.select("nr", "source", F.col("target").alias("node")), steps, F.col("nr")).withColumnRenamed("root", "a").drop("node")
    then = roots(then.withColumn("node", F.col("source")), steps, F.col("nr")).withColumnRenamed("root", "b").drop("node")
    mine = edges.select(F.col("source").alias("s"), F.col("nr").alias("n"))
    then = then.join(mine, (then["source"] == mine["s"]) & (then["nr"] == mine["n"]), "left")
    own = every.select("source", "nr", (F.col("source") == F.col("target")).alias("self")).toDF("s2", "n2", "self")
    then = then.join(own, (then["source"] == own["s2"]) & (then["nr"] == own["n2"]))
    outcome = F.when(F.col("self"), "self").when(F.col("n").isNotNull(), "merged").when(F.col("a") == F.col("source"), "loop").when(F.col("a") == F.col("b"), "noop").otherwise("elsewhere")
    return stored(kept, "mapping"), stored(then.select("nr", outcome.alias("outcome"), F.col("a").alias("target_id")), "merge-outcomes")
