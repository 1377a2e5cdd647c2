"""Rule-based classification, comparison of groups, and searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.indicators import author_string, cites, long_sum
from marginalia.operators.terms import TermIndex

MIN_YEAR = 1996


FIELDS = ("title", "abstract", "author_keywords", "indexed_keywords")


def continent_matches(wanted: Column, continents: Column) -> Column:
    """One of the continents is the wanted one, or a list apart by / that holds it."""
    w = F.lower(F.trim(wanted))
    own = F.transform(continents, lambda x: F.lower(F.trim(x)))
    return F.exists(own, lambda x: (x == w) | F.exists(F.split(x, "/"), lambda y: F.trim(y) == w))


def passes_filters(docs: DataFrame, groups: DataFrame) -> Column:
    """Whether a document's row passes a group's filters, of those columns that both tables have: groups(qualis, start_year,
    end_year, continent, country_ids, nature, authors), docs(qualis, year, continents, countries, natures, authors)."""
    has = lambda d, g: d in docs.columns and g in groups.columns
    low = lambda c: F.transform(c, F.lower)
    d, g = (lambda c: F.col(f"d.{c}")), (lambda c: F.col(f"g.{c}"))
    within = lambda own, wanted: F.exists(low(own), lambda x: F.exists(low(wanted), lambda y: x.contains(y)))
    tests = [F.lit(True)]

    def add(test: Column, unset: Column) -> None:
        tests.append(unset | F.coalesce(test, F.lit(False)))

    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    if has("qualis", "qualis"):
        add(F.array_contains(F.transform(g("qualis"), F.upper), F.upper(d("qualis"))), empty(g("qualis")))
    if "start_year" in groups.columns:
        add(d("year") >= g("start_year"), g("start_year").isNull())
    if "end_year" in groups.columns:
        add(d("year") <= g("end_year"), g("end_year").isNull())
    if has("continents", "continent"):
        add(continent_matches(g("continent"), d("continents")), F.coalesce(g("continent"), F.lit("")) == "")
    if has("countries", "country_ids"):
        add(F.arrays_overlap(low(d("countries")), low(g("country_ids"))), empty(g("country_ids")))
    if has("natures", "nature"):
        add(within(d("natures"), g("nature")), empty(g("nature")))
    if has("authors", "authors"):
        add(within(d("authors"), g("authors")), empty(g("authors")))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def parse_authors(raw: str) -> list[str]:
    """Names apart by ; or lines, or else by commas, where initials belong to the name before them."""
    if re.search(r"[;\r\n]", raw):
        parts = re.split(r"[;\r\n]+", raw)
    else:
        parts = []
        for piece in raw.split(","):
            initials = 1 <= len(re.sub(r"[.\s]", "", piece)) <= 3 and all(c.isupper() or c in ". " for c in piece)
            if parts and initials:
                parts[-1] += ", " + piece.strip()
            else:
                parts.append(piece.strip())
    return [x.strip() for x in parts if x.strip()]


def term_hits(docs: DataFrame, rules: DataFrame, text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """document_id, group_id, term: for each group the first rule (by position) whose term the text holds, as a substring
    of lower case. All terms are in one automaton, which reads each text once, whatever their number. With groups, normal
    ones count only for documents that pass their filters, and each looks at its own match_fields if docs has them."""
    own = rules.select("group_id", F.col("position").alias("rule"), F.lower(F.trim("term")).alias("term")).where("term <> ''")
    fields = [f for f in FIELDS if f in docs.columns]
    searched, passes = {None: F.lower(F.col(text))} if text in docs.columns else {}, F.lit(True)
    own = own.withColumn("fields", F.lit(None).cast("string"))
    if groups is not None:
        own = own.join(groups.withColumnRenamed("id", "group_id").drop("position"), "group_id")
        passes = (F.col("g.type") != "normal") | passes_filters(docs, groups)
        if fields and "match_fields" in groups.columns:
            chosen = F.coalesce(F.array_join(F.array_intersect(F.array(*map(F.lit, fields)), "match_fields"), ","), F.lit(",".join(fields)))
            own = own.withColumn("fields", chosen)
            each = [r[0] for r in own.select("fields").distinct().collect()]  # at most 16 choices of four fields
            searched = {c: F.concat_ws(" ", *(F.lower(F.col(f)) for f in c.split(",") if f)) for c in each}
    index = TermIndex(own.select("term"))
    found = None
    for c, column in searched.items():
        part = index.search(docs, column).withColumn("searched", F.lit(c).cast("string"))
        found = part if found is None else found.unionByName(part)
    own = F.broadcast(own.join(index.numbers(), "term"))  # rules are configuration; dealt by term, all hits would be the work of few tasks
    rows = found.alias("d").join(own.alias("g"), (F.col("d.number") == F.col("g.number")) & F.col("d.searched").eqNullSafe(F.col("g.fields")) & passes)
    return rows.groupBy("document_id", "group_id").agg(F.min_by("term", F.struct("rule", "term")).alias("term"))


def classify(docs: DataFrame, groups: DataFrame, rules: DataFrame, min_year: int = MIN_YEAR, text: str = "text") -> DataFrame:
    """classify_whole without the column `rejected`."""
    return classify_whole(docs, groups, rules, min_year, text).drop("rejected")


def classify_whole(docs: DataFrame, groups: DataFrame, rules: DataFrame, min_year: int = MIN_YEAR, text: str = "text") -> DataFrame:
    """document_id, group_id, term, rejected (the document is noise, be there a group for it or not) for docs(document_id, year, text): below the least year noise; a noise term noise;
    without a validator's term noise, without a term; else every normal group whose filters it passes and of which it
    holds a term, or unclassified (group null).

    groups(id, type, position and filters, see passes_filters): type validator, noise or normal. The noise group is the
    first one; without one noise is unclassified. Texts may be in FIELDS instead, chosen by groups' match_fields.
    """
    kinds = groups.select(F.col("id").alias("group_id"), F.col("type").alias("kind"), F.col("position").alias("group_position"))
    hits = term_hits(docs, rules, text, groups).join(F.broadcast(kinds), "group_id")
    per = hits.groupBy("document_id").agg(
        F.min_by(F.struct("group_id", "term"), F.when(F.col("kind") == "noise", F.struct("group_position", "group_id"))).alias("noise"),
        F.count(F.when(F.col("kind") == "validator", 1)).alias("validators"),
        F.collect_list(F.when(F.col("kind") == "normal", F.struct("group_id", "term"))).alias("normal"),  # of one document
    )
    has_term = rules.where("trim(term) <> ''").select(F.col("group_id").alias("id")).distinct()
    one = groups.agg(F.min_by("id", F.when(F.col("type") == "noise", F.struct("position", "id"))).alias("noise_group")).crossJoin(groups.where("type = 'validator'").join(has_term, "id", "left_semi").agg(F.count("*").alias("n_validators")))
    rows = docs.select("document_id", "year").join(per, "document_id", "left").crossJoin(F.broadcast(one))  # one row
    early = (F.col("year") > 0) & (F.col("year") < min_year)
    own = lambda g, t: F.array(F.struct(g.cast("int").alias("group_id"), t.alias("term")))
    none = F.lit(None).cast("string")
    normal = F.transform(F.coalesce("normal", F.array()), lambda x: F.struct(x["group_id"].cast("int").alias("group_id"), x["term"].alias("term")))
    unknown = (F.col("n_validators") > 0) & (F.coalesce("validators", F.lit(0)) == 0)
    rejected = F.coalesce(early, F.lit(False)) | F.col("noise").isNotNull() | unknown
    found = (
        F.when(early, own(F.col("noise_group"), F.when(F.col("noise_group").isNotNull(), f"year<{min_year}")))
        .when(F.col("noise").isNotNull(), own(F.col("noise.group_id"), F.col("noise.term")))
        .when(unknown, own(F.col("noise_group"), none))
        .when(F.size(normal) > 0, normal).otherwise(own(F.lit(None), none))
    )
    return rows.select("document_id", rejected.alias("rejected"), F.explode(found).alias("x")).select("document_id", "x.group_id", "x.term", "rejected")


def classification_counts(whole: DataFrame) -> DataFrame:
    """kind, group_id, n of classify_whole's rows: total, noise, unclassified, multi and rejected_unassigned (noise without a
    group for it) in documents, by_group in assignments (group null: unclassified). One pass over documents, one over rows."""
    per = whole.groupBy("document_id").agg(F.count("group_id").alias("n"), F.bool_or("rejected").alias("rejected"))
    of = {"total": F.lit(True), "noise": F.col("rejected") & (F.col("n") > 0), "unclassified": F.col("n") == 0, "multi": (F.col("n") > 1) & ~F.col("rejected"), "rejected_unassigned": F.col("rejected") & (F.col("n") == 0)}
    one = per.agg(*(F.count_if(test).alias(name) for name, test in of.items()))
    kinds = one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("kind"), F.lit(None).cast("int").alias("group_id"), F.col(name).alias("n")) for name in of))))
    return kinds.unionByName(whole.groupBy("group_id").agg(F.count("*").alias("n")).select(F.lit("by_group").alias("kind"), "group_id", "n"))


def classification_stats(assigned: DataFrame, groups: DataFrame) -> DataFrame:
    per = assigned.groupBy("document_id").agg(F.count("group_id").alias("n"))
    one = per.agg(F.count("*").alias("total"), F.count(F.when(F.col("n") == 0, 1)).alias("unclassified"), F.count(F.when(F.col("n") > 1, 1)).alias("multi"))
    noise = assigned.join(groups.where("type = 'noise'").select(F.col("id").alias("group_id")), "group_id", "left_semi").agg(F.countDistinct("document_id").alias("noise"))
    return one.crossJoin(noise)  # one row each


def group_stats(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents, citations, mean and years per group."""
    rows = assigned.where("group_id IS NOT NULL").select("document_id", "group_id").distinct().join(docs.select(F.col("id").alias("document_id"), cites().alias("cited"), "year"), "document_id")
    return rows.groupBy("group_id").agg(F.count("*").alias("doc_count"), long_sum(F.col("cited")).alias("citations"), F.round(F.avg("cited"), 1).alias("avg_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def group_top_documents(assigned: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    rows = assigned.where("group_id IS NOT NULL").select("document_id", "group_id").distinct().join(docs.select(F.col("id").alias("document_id"), cites().alias("cited")), "document_id")
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("cited"), "document_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def group_top_journals(assigned: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    rows = assigned.where("group_id IS NOT NULL").select("document_id", "group_id").distinct().join(docs.select(F.col("id").alias("document_id"), "source_title").where("source_title <> ''"), "document_id")
    per = rows.groupBy("group_id", "source_title").agg(F.count("*").alias("doc_count"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("doc_count"), "source_title"))).where(F.col("rank") <= k)


def group_years(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    rows = assigned.where("group_id IS NOT NULL").select("document_id", "group_id").distinct().join(docs.select(F.col("id").alias("document_id"), "year").where("year > 1900"), "document_id")
    return rows.groupBy("group_id", "year").agg(F.count("*").alias("doc_count"))


def group_overlap(assigned: DataFrame, words: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of groups: shared labels, all labels, Jaccard. A label counts for a group from `least` documents on."""
    rows = assigned.where("group_id IS NOT NULL").select("document_id", "group_id").distinct().join(words.select("document_id", "keyword").distinct(), "document_id").join(labels, "keyword")
    key = F.lower(F.trim("label"))
    own = rows.groupBy("group_id", key.alias("label")).agg(F.countDistinct("document_id").alias("n")).where(F.col("n") >= least).select("group_id", "label")
    sized = own.groupBy("group_id").agg(F.count("*").alias("size"))
    both = own.toDF("a", "label").join(own.toDF("b", "label"), "label").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = both.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
    union = F.col("na") + F.col("nb") - F.col("shared")
    return rows.select("a", "b", "shared", union.alias("either"), F.round(F.col("shared") / union, 3).alias("jaccard"))


def assignments_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(group_id, document_id, change) of documents that enter or leave a group."""
    a, b = (x.where("group_id IS NOT NULL").select("group_id", "document_id").distinct() for x in (before, after))
    keys = ["group_id", "document_id"]
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("enters")).union(a.join(b, keys, "left_anti").withColumn("change", F.lit("leaves")))


def lens_matches(docs: DataFrame, lenses: DataFrame, samples: int = 5) -> DataFrame:
    """lens, doc_count and first documents: a lens's term must stand between characters that are no letters or digits."""
    own = lenses.select("lens", F.lower("term").alias("term")).where("term <> ''").distinct()
    index = TermIndex(own.select("term"))
    rows = index.search(docs.select("document_id", F.lower("text").alias("text")), F.col("text"), words=True).drop("text").join(own.join(index.numbers(), "term"), "number")
    rows = rows.select("lens", "document_id").distinct()
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lens").orderBy("document_id"))).where(F.col("rn") <= samples)  # each task keeps so many of a lens
    shown = first.groupBy("lens").agg(F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("samples"))
    return rows.groupBy("lens").agg(F.count("*").alias("doc_count")).join(shown, "lens")


def document_search(docs: DataFrame, title: str | None = None, year: int | None = None, authors: DataFrame | None = None, keywords: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """docs(document_id, year, text) that fit all that is given; authors and keywords are (document_id) of those that do."""
    out = docs
    if year is not None:
        out = out.where(F.col("year") == year)
    if title:
        out = out.where(F.lower("text").contains(title.strip().lower()))
    for ids in (authors, keywords):
        if ids is not None:
            out = out.join(ids, "document_id", "left_semi")
    return out.orderBy(F.desc("year"), "text", "document_id").limit(limit)


def classified_page(assigned: DataFrame, docs: DataFrame, author_links: DataFrame, authors: DataFrame, group_id: int | None, page: int = 1, limit: int = 100) -> DataFrame:
    """A page of a group's documents, of those without a group if it is None: the most cited first, then the latest.
    Author strings are made for the page's few documents alone."""
    rows = assigned.where(F.col("group_id").isNull() if group_id is None else F.col("group_id") == group_id).select("document_id", "term")
    rows = rows.join(docs.select(F.col("id").alias("document_id"), "year", "source_title", "cited_by"), "document_id")
    order = [F.desc_nulls_last("cited_by"), F.desc_nulls_last("year"), F.col("document_id"), F.col("term")]
    top = rows.orderBy(*order).offset(max(0, (page - 1) * limit)).limit(max(1, limit))
    names = author_string(author_links.join(F.broadcast(top.select("document_id").distinct()), "document_id", "left_semi"), authors)  # a page
    return top.join(names, "document_id", "left")


def move(assigned: DataFrame, document_id: int, source: int | None, target: int | None) -> DataFrame:
    """assigned(document_id, group_id, term, manual) after a document was moved by hand from one group to another, null for
    none: its row gets the target and is manual; where the document is in the target already, the source's row goes and
    the target's is manual. Nothing changes if the document isn't in the source."""
    here = F.col("document_id") == document_id
    at = lambda g: here & F.col("group_id").eqNullSafe(F.lit(g).cast("int"))
    if source == target or assigned.where(at(source)).isEmpty():
        return assigned
    if not assigned.where(at(target)).isEmpty():
        return assigned.where(~at(source)).withColumn("manual", F.col("manual") | at(target))
    moved = at(source)
    return assigned.select("document_id", F.when(moved, F.lit(target).cast("int")).otherwise(F.col("group_id")).alias("group_id"), "term", (F.col("manual") | moved).alias("manual"))
