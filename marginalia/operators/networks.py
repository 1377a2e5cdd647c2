"""Networks, thematic structure, flows and matrices.

Node sets are cut to the top N before any pair is made, so a document with hundreds of links makes few pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.store import stored


def top_nodes(pairs: DataFrame, key: str, limit: int, min_docs: int = 1) -> DataFrame:
    """key, doc_count of the first nodes by documents; ties by id."""
    per = pairs.groupBy(key).agg(F.count("*").alias("doc_count")).where(F.col("doc_count") >= min_docs)
    return per.orderBy(F.desc("doc_count"), key).limit(min(limit, 1000))


def co_edges(pairs: DataFrame, nodes: DataFrame, key: str, min_weight: int = 1) -> DataFrame:
    """source < target, weight: documents that hold both. pairs(document_id, key) must be distinct."""
    kept = pairs.join(F.broadcast(nodes.select(key)), key, "left_semi")  # 1000 nodes at most
    a, b = kept.select("document_id", F.col(key).alias("source")), kept.select("document_id", F.col(key).alias("target"))
    return a.join(b, "document_id").where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def country_nodes(links: DataFrame) -> DataFrame:
    """Countries ranked by documents, then name; the rank is the id. One row a country is ranked."""
    per = links.select("document_id", F.trim("country").alias("country")).distinct().groupBy("country").agg(F.count("*").alias("doc_count"))
    return per.select(F.row_number().over(Window.orderBy(F.desc("doc_count"), "country")).alias("id"), "country", "doc_count")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id"), "weight").union(edges.select("target", "weight"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    d = F.when(F.col("nodes") > 1, F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)).otherwise(F.lit(0.0))
    return n.crossJoin(e).select("nodes", "edges", d.alias("density"))  # one row each


def association(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with strength weight / (n_source * n_target), 0 if any of them isn't positive."""
    n = F.broadcast(nodes.select(F.col(key).alias("id"), "doc_count"))  # 1000 at most
    rows = edges.join(n.toDF("source", "n_source"), "source").join(n.toDF("target", "n_target"), "target")
    positive = (F.col("weight") > 0) & (F.col("n_source") > 0) & (F.col("n_target") > 0)
    return rows.select("source", "target", "weight", "n_source", "n_target", F.when(positive, F.col("weight") / (F.col("n_source") * F.col("n_target"))).otherwise(F.lit(0.0)).alias("strength"))


def louvain(nodes: list, edges: list[tuple], runs: int = 10, seed: int = 42, resolution: float = 1.0) -> dict:
    """node -> cluster of the best of several seeded runs, by modularity; strict improvements only."""
    biggest = max((w for _, _, w in edges), default=0) or 1.0
    best, best_q = {n: i for i, n in enumerate(nodes)}, None
    for r in range(runs):
        graph: dict = {n: {} for n in nodes}
        for a, b, w in edges:
            graph[a][b] = graph[a].get(b, 0.0) + w / biggest
            graph[b][a] = graph[b].get(a, 0.0) + w / biggest
        member, rng = {n: n for n in nodes}, random.Random(seed + r)
        while True:
            total = sum(sum(x.values()) for x in graph.values())
            if total <= 0:
                break
            degree = {n: sum(x.values()) for n, x in graph.items()}
            of, sums = {n: n for n in graph}, dict(degree)
            moved_any = False
            for _ in range(100):
                order, moved = list(graph), False
                rng.shuffle(order)
                for n in order:
                    home = of[n]
                    sums[home] -= degree[n]
                    near: dict = {home: 0.0}
                    for m, w in graph[n].items():
                        if m != n:
                            near[of[m]] = near.get(of[m], 0.0) + w
                    gain = lambda c: near[c] - resolution * sums[c] * degree[n] / total  # noqa: B023, E731
                    top = home
                    for c in near:
                        if gain(c) > gain(top) + 1e-12:
                            top = c
                    sums[top] += degree[n]
                    if top != home:
                        of[n], moved, moved_any = top, True, True
                if not moved:
                    break
            if not moved_any:
                break
            member = {n: of[c] for n, c in member.items()}
            new: dict = {c: {} for c in dict.fromkeys(of.values())}
            for n, x in graph.items():
                for m, w in x.items():
                    new[of[n]][of[m]] = new[of[n]].get(of[m], 0.0) + w
            graph = new
        q = modularity(member, edges)
        if best_q is None or q > best_q + 1e-12:
            best, best_q = member, q
    names = {c: i for i, c in enumerate(dict.fromkeys(best[n] for n in nodes))}
    return {n: names[best[n]] for n in nodes}


def modularity(member: dict, edges: list[tuple]) -> float:
    total = sum(w for _, _, w in edges)
    if total <= 0:
        return 0.0
    inner, ends = {}, {}
    for a, b, w in edges:
        ends[member[a]] = ends.get(member[a], 0.0) + w
        ends[member[b]] = ends.get(member[b], 0.0) + w
        if member[a] == member[b]:
            inner[member[a]] = inner.get(member[a], 0.0) + w
    return sum(inner.get(c, 0.0) / total - (x / (2 * total)) ** 2 for c, x in ends.items())


def modularity_of(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """modularity of the clusters a and b that the ends of the edges have, in one row: over all clusters the share of the
    weight inside less the square of the share of the ends; 0 without weight."""
    w, same = F.col(weight), F.col("a") == F.col("b")
    ends = F.array(F.struct(F.col("a").alias("cluster"), F.when(same, w).otherwise(0.0).alias("inside"), w.alias("w")), F.struct(F.col("b").alias("cluster"), F.lit(0.0).alias("inside"), w.alias("w")))
    per = edges.select(F.explode(ends).alias("x")).select("x.*").groupBy("cluster").agg(F.sum("inside").alias("inside"), F.sum("w").alias("ends"))
    total = edges.agg(F.coalesce(F.sum(w), F.lit(0)).alias("total"))
    share = F.when(F.col("total") > 0, F.col("inside") / F.col("total") - F.pow(F.col("ends") / (2 * F.col("total")), 2))
    return per.crossJoin(total).agg(F.round(F.coalesce(F.sum(share), F.lit(0.0)), 9).alias("modularity"))  # total is one row


def label_propagation(nodes: list, edges: list[tuple], rounds: int = 10, seed: int = 42) -> dict:
    """Asynchronous label propagation in seeded order; of equal sums the label met first."""
    near: dict = {n: [] for n in nodes}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label, rng = {n: n for n in nodes}, random.Random(seed)
    for _ in range(rounds):
        order, changed = list(nodes), False
        rng.shuffle(order)
        for n in order:
            sums: dict = {}
            for m, w in near[n]:
                sums[label[m]] = sums.get(label[m], 0.0) + w
            if sums and (top := max(sums, key=sums.get)) != label[n]:
                label[n], changed = top, True
        if not changed:
            break
    names = {c: i for i, c in enumerate(dict.fromkeys(label[n] for n in nodes))}
    return {n: names[label[n]] for n in nodes}


def label_rounds(edges: DataFrame, weight: str = "weight", rounds: int = 10) -> DataFrame:
    """id, label: synchronous label propagation over edges(source, target, weight) of any number of nodes.

    In a round every node sends its label over its edges; a node takes the label of the greatest sum of weights, its own if
    that is among them, else the least. Sums are aggregates by node and label, so a node with very many neighbours is no task's
    work; each round is a table. It ends when no label changes or after `rounds`. A node is first labelled by itself.
    """
    ends = lambda a, b: edges.select(F.col(a).alias("of"), F.col(b).alias("id"), F.col(weight).alias("w"))
    links = stored(ends("source", "target").union(ends("target", "source")).where("of <> id AND w > 0"), "links")
    now = stored(links.select("id").distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        sums = links.join(now.toDF("of", "label"), "of").groupBy("id", "label").agg(F.sum("w").alias("w"))
        best = sums.join(now.toDF("id", "own"), "id").groupBy("id", "own").agg(F.max(F.struct("w", (F.col("label") == F.col("own")).alias("stays"), (-F.col("label")).alias("least"))).alias("top"))
        after = stored(best.select("id", (-F.col("top.least")).alias("label"), (F.col("own") != -F.col("top.least")).alias("moved")), "labels")
        now = after.select("id", "label")
        if after.where("moved").isEmpty():
            break
    return now


def clustered(edges: DataFrame, weight: str = "strength", method: str = "louvain") -> DataFrame:
    """The edges of positive weight with the clusters a and b of their ends. At most top_nodes' 1000 nodes reach the one
    task that runs the method."""
    run_method = louvain if method == "louvain" else label_propagation

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (parts := list(parts)):
            return
        rows = pd.concat(parts).sort_values(["source", "target"])
        links = list(zip(rows["source"].tolist(), rows["target"].tolist(), rows[weight].astype(float).tolist(), strict=True))
        found = run_method(sorted({x for a, b, _ in links for x in (a, b)}), links)
        yield rows.assign(a=rows["source"].map(found).astype("int64"), b=rows["target"].map(found).astype("int64"))

    few = edges.where(F.col(weight) > 0)
    return few.repartition(1).mapInPandas(run, few.schema.add("a", "long").add("b", "long"))


def clusters(edges: DataFrame, weight: str = "strength", method: str = "louvain") -> DataFrame:
    """id, cluster over the edges' nodes."""
    ends = F.explode(F.array(*(F.struct(F.col(n).cast("long").alias("id"), F.col(k).alias("cluster")) for n, k in (("source", "a"), ("target", "b")))))
    return clustered(edges, weight, method).select(ends.alias("x")).select("x.*").distinct()


def theme_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Callon's centrality (links to other themes) and density (100 x links inside / size) of each cluster."""
    m = members.select("id", "cluster")
    rows = edges.join(m.toDF("source", "a"), "source").join(m.toDF("target", "b"), "target")
    inside = rows.where("a = b").groupBy(F.col("a").alias("cluster")).agg(F.sum("strength").alias("inside"))
    outside = rows.where("a <> b").select(F.explode(F.array("a", "b")).alias("cluster"), "strength").groupBy("cluster").agg(F.sum("strength").alias("outside"))
    sized = m.groupBy("cluster").agg(F.count("*").alias("size"))
    out = sized.join(inside, "cluster", "left").join(outside, "cluster", "left").na.fill(0.0, ["inside", "outside"])
    return out.select("cluster", "size", F.round("outside", 6).alias("centrality"), F.round(100 * F.col("inside") / F.col("size"), 6).alias("density"))


def of_years(words: DataFrame, docs: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """words of documents of the years, both inclusive, in either order; None or a year outside 1000 to 2200 is no limit."""
    first, last = (y if y is not None and 1000 <= y <= 2200 else None for y in (first, last))
    if first is not None and last is not None and first > last:
        first, last = last, first
    if first is None and last is None:
        return words
    own = docs.where(F.col("year").between(first if first is not None else -(2**31), last if last is not None else 2**31 - 1))
    return words.join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def themes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each cluster of edges(source, target, strength, n_source, n_target, a, b): label of its most frequent keyword, size,
    documents, Callon's centrality and density, and the quadrant that the medians of both give. The edges are read once."""
    own = lambda node, n, cluster, inside: F.struct(F.col(cluster).alias("cluster"), F.col(node).alias("keyword"), F.col(n).alias("doc_count"), inside.alias("inside"), F.when(F.col("a") != F.col("b"), F.col("strength")).otherwise(0.0).alias("outside"))
    ends = F.array(own("source", "n_source", "a", F.when(F.col("a") == F.col("b"), F.col("strength")).otherwise(0.0)), own("target", "n_target", "b", F.lit(0.0)))
    per = edges.select(F.explode(ends).alias("x")).select("x.*").groupBy("cluster", "keyword").agg(F.max("doc_count").alias("doc_count"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    out = per.join(labels, "keyword", "left").groupBy("cluster").agg(
        F.min_by("label", F.struct(-F.col("doc_count"), F.col("keyword"))).alias("label"), F.count("*").alias("size"), F.sum("doc_count").alias("doc_count"),
        F.round(F.sum("outside"), 6).alias("centrality"), F.round(100 * F.sum("inside") / F.count("*"), 6).alias("density"),
    )
    every = Window.partitionBy()  # a row for each theme, at most as many as nodes
    axes = {f"{k}_{c}": F.round(f(c).over(every), 6) for c in ("centrality", "density") for k, f in (("avg", F.avg), ("median", F.median))}
    central, dense = (F.col(c) >= F.col(f"median_{c}") for c in ("centrality", "density"))
    return out.withColumns(axes).withColumn("quadrant", F.when(central & dense, "motor").when(central, "basic").when(dense, "niche").otherwise("emerging"))


def thematic_map(words: DataFrame, labels: DataFrame, limit: int = 100, min_docs: int = 2, docs: DataFrame | None = None, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The themes of the words, or of those of some years of docs. No rows without keywords that share a document."""
    if docs is not None:
        words = of_years(words, docs, first_year, last_year)
    nodes = top_nodes(words, "keyword", limit, min_docs)
    return themes(clustered(association(co_edges(words, nodes, "keyword"), nodes, "keyword")), labels)


def thematic_evolution(words: DataFrame, docs: DataFrame, labels: DataFrame, cutoff: int, limit: int = 100) -> DataFrame:
    """Themes up to the cutoff year and after it, with their inclusion: shared keywords / the smaller theme's size."""
    dated = words.join(docs.select(F.col("id").alias("document_id"), "year"), "document_id")
    sides = []
    for name, side in (("before", dated.where(F.col("year") <= cutoff)), ("after", dated.where(F.col("year") > cutoff))):
        pairs = side.select("document_id", "keyword")
        nodes = top_nodes(pairs, "keyword", limit, 2)
        found = clusters(association(co_edges(pairs, nodes, "keyword"), nodes, "keyword"))
        sides.append(found.select("id", F.col("cluster").alias(name), F.count("*").over(Window.partitionBy("cluster")).alias(f"n_{name}")))  # a row a node
    out = sides[0].join(sides[1], "id").groupBy("before", "after", "n_before", "n_after").agg(F.count("*").alias("shared"))
    return out.select("before", "after", "shared", F.round(F.col("shared") / F.least("n_before", "n_after"), 3).alias("inclusion"))


def three_fields(fields: list[DataFrame], limit: int = 20, min_weight: int = 1) -> DataFrame:
    """Links between neighbouring fields, each field a (document_id, id, name): the top ids of each by documents, links by
    name and once per document."""
    tops = []
    for f in fields:
        top = f.select("document_id", "id").distinct().groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit)
        tops.append(f.join(top.select("id"), "id", "left_semi").select("document_id", "name").distinct())
    out = []
    for k, (a, b) in enumerate(zip(tops, tops[1:], strict=False)):
        link = a.withColumnRenamed("name", "source").join(b.withColumnRenamed("name", "target"), "document_id")
        out.append(link.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight).select(F.lit(k).alias("stage"), "source", "target", "weight"))
    return out[0].union(out[1]) if len(out) > 1 else out[0]


def dimension(rows: DataFrame, value: str) -> DataFrame:
    """(document_id, value), trimmed, distinct, without empty values and the string 0."""
    v = F.trim(F.col(value).cast("string"))
    return rows.select("document_id", v.alias("value")).where("value IS NOT NULL AND value <> '' AND value <> '0'").distinct()


def matrix(rows: DataFrame, cols: DataFrame, limit: int = 30, min_weight: int = 1) -> DataFrame:
    """row, col, weight of a contingency matrix. The weight of a label is its number of (document, other label) pairs;
    equal labels have no cell. Label weights come from counts per document, no pair is made before the cut."""
    per_row = rows.groupBy("document_id").agg(F.count("*").alias("n_rows"))
    per_col = per_row.withColumnRenamed("n_rows", "n_cols") if rows is cols else cols.groupBy("document_id").agg(F.count("*").alias("n_cols"))

    # pairs of a label with the other side, less the pair with itself where the other side holds it too
    def top(side: DataFrame, other: DataFrame, per: DataFrame, n: str, name: str) -> DataFrame:
        both = side.withColumn("same", F.lit(1)) if side is other else side.join(other.withColumn("same", F.lit(1)), ["document_id", "value"], "left")
        w = both.join(per, "document_id").groupBy("value").agg(F.sum(F.col(n) - F.coalesce("same", F.lit(0))).alias("w")).where("w > 0")
        return F.broadcast(w.orderBy(F.desc("w"), "value").limit(limit).select(F.col("value").alias(name)))

    r = top(rows, cols, per_col, "n_cols", "row")
    c = r.withColumnRenamed("row", "col") if rows is cols else top(cols, rows, per_row, "n_rows", "col")
    left = rows.withColumnRenamed("value", "row").join(r, "row", "left_semi")
    right = cols.withColumnRenamed("value", "col").join(c, "col", "left_semi")
    return left.join(right, "document_id").where("row <> col").groupBy("row", "col").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)
