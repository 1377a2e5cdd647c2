"""Treatment of keywords and authors: cleaning, thesaurus matching, masters of repeated names, review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.forms import author_forms, is_acronym, keyword_forms
from marginalia.functions.text import clean_display_udf, normalize_udf
from marginalia.operators.similarity import similar_text

AUTO, REVIEW, GAP = 95.0, 75.0, 3.0


def cleaned_keywords(keywords: DataFrame) -> DataFrame:
    """What cleaning does to each of keywords(id, original, display, normalized, type): action, the new forms, the reason
    and the keyword it goes into.

    invalid: no keyword; merged: its new form is another keyword's of its type (one that has it already before one that
    gets it, then the least id); cleaned: new forms; kept. review_reasons are set where a valid one looks odd.
    """
    rows = keywords.select("id", "original", "display", "normalized", "type", keyword_forms(F.col("original")).alias("f"))
    rows = rows.select("id", "type", "display", "normalized", F.col("f.valid").alias("valid"), F.col("f.reason").alias("reason"), F.col("f.display").alias("new_display"), F.col("f.normalized").alias("new_normalized"), F.col("f.review_reasons").alias("review_reasons"))
    dirty = F.col("valid") & ~(F.col("new_display").eqNullSafe(F.col("display")) & F.col("new_normalized").eqNullSafe(F.col("normalized")))
    rows = rows.withColumn("dirty", dirty)
    had = keywords.groupBy("type", F.col("normalized").alias("new_normalized")).agg(F.min("id").alias("had1"), F.max("id").alias("had2"))
    gets = rows.where("dirty").groupBy("type", "new_normalized").agg(F.min("id").alias("gets"))
    rows = rows.join(had, ["type", "new_normalized"], "left").join(gets, ["type", "new_normalized"], "left")
    other = lambda c: F.when(F.col(c) != F.col("id"), F.col(c))
    into = F.coalesce(other("had1"), other("had2"), F.when(F.col("gets") < F.col("id"), F.col("gets")))
    into = F.when(F.col("dirty"), into)
    action = F.when(~F.col("valid"), "invalid").when(into.isNotNull(), "merged").when(F.col("dirty"), "cleaned").otherwise("kept")
    return rows.select("id", "type", action.alias("action"), "reason", "new_display", "new_normalized", into.alias("merged_into"), F.nullif("review_reasons", F.lit("")).alias("review_reasons"))


def diagnosis(keywords: DataFrame, links: DataFrame, concepts: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counters of keywords(id, original, display, normalized, type, status, keyword_concept_id,
    thesaurus_concept_id), links(document_id, keyword_id), the thesaurus's concepts and labels(concept_id), and
    matches(entity_type, status) that wait for a decision."""
    shown = F.coalesce("display", "original")
    rows = keywords.withColumn("shown", shown)
    rows = rows.withColumn("clean", clean_display_udf("shown")).withColumn("f", keyword_forms(F.col("shown")))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    c = F.col
    one = rows.agg(
        F.count("*").alias("total"), count(F.coalesce(c("display"), F.lit("")) == "", "no_display"), count(c("normalized") == "", "no_normalized"), count(c("clean") != c("shown"), "dirty"), count(~c("f.valid"), "invalid"),
        count(c("f.needs_review"), "suspicious"), count(c("thesaurus_concept_id").isNull(), "no_concept"), count(c("thesaurus_concept_id").isNotNull(), "with_concept"),
        count(c("keyword_concept_id").isNotNull() & c("thesaurus_concept_id").isNull(), "keyword_concept"), count(c("type") == "author_keyword", "author_keywords"), count(c("type") == "indexed_keyword", "indexed_keywords"), count(c("status") == 0, "inactive"),
    )
    twice = keywords.where("normalized <> ''").groupBy("normalized").agg(F.count("*").alias("n")).agg(count(c("n") > 1, "duplicates"))
    linked = links.agg(F.count("*").alias("links"), F.countDistinct("document_id").alias("documents"))
    known = concepts.agg(F.count("*").alias("concepts"))
    named = labels.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").agg(F.count("*").alias("labels"))
    waiting = matches.agg(count((c("status") == "pending") & (c("entity_type") == "keyword"), "pending"))
    for row in (twice, linked, known, named, waiting):
        one = one.crossJoin(row)  # one row each
    return one


# ---- thesaurus ----


def _similar_share(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([200.0 * similar_text(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_score(a: Column, b: Column, display_a: Column, display_b: Column, least: float = 0.0) -> Column:
    """0 for texts under four letters and acronyms, else the lesser of the shares, in percent, that edit distance and
    common runs leave. Where the distance alone gives less than `least` the runs aren't looked for, and it is 0."""
    longer = F.greatest(F.length(a), F.length(b))
    by_distance = (1 - F.levenshtein(a, b) / longer) * 100
    out = (F.least(F.length(a), F.length(b)) < 4) | F.coalesce(is_acronym(F.coalesce(display_a, a)), F.lit(False)) | F.coalesce(is_acronym(F.coalesce(display_b, b)), F.lit(False)) | (by_distance < least)
    return F.when(out, 0.0).otherwise(F.least(by_distance, F.pandas_udf(_similar_share, "double")(a, b)))


def thesaurus_matches(keywords: DataFrame, labels: DataFrame, concepts: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """id, method, concept_id, score, ambiguous of each of keywords(id, normalized, display), from labels(normalized,
    label, concept_id) and concepts(id, normalized, label).

    A label that is equal, then a concept that is; else the best score of at least `review` among forms with the same
    first character: fuzzy_auto from `auto` on, unless a second concept scores within three points. Of equal labels or
    scores the least concept counts. Only the distinct forms of keywords without an equal label are compared, and only
    with forms whose length can reach the score: a form is sent to each of these lengths and meets keywords by an equi-join.
    """
    named = labels.select("normalized", "label", "concept_id", F.lit(0).alias("rank")).union(concepts.select("normalized", "label", F.col("id"), F.lit(1))).where("normalized <> ''")
    forms = named.groupBy("normalized").agg(F.min(F.struct("rank", "concept_id", "label")).alias("x")).select(F.col("normalized").alias("form"), "x.rank", "x.concept_id", F.col("x.label").alias("form_label"))
    own = keywords.select("id", "normalized", "display").where("normalized <> ''")
    exact = own.join(forms, F.col("normalized") == F.col("form")).select("id", F.when(F.col("rank") == 0, "exact_label").otherwise("exact_concept").alias("method"), "concept_id", F.lit(100.0).alias("score"), F.lit(False).alias("ambiguous"))
    rest = own.join(forms.select(F.col("form").alias("normalized")), "normalized", "left_anti").withColumn("acronym", F.coalesce(is_acronym("display"), F.lit(False)))
    asked = rest.where((F.length("normalized") >= 4) & ~F.col("acronym")).select("normalized").distinct().select("normalized", F.substring("normalized", 1, 1).alias("first"), F.length("normalized").alias("size"))
    sized = forms.where(F.length("form") >= 4).where(~F.coalesce(is_acronym("form_label"), F.lit(False)))
    reach = sized.select("form", "concept_id", F.substring("form", 1, 1).alias("first"), F.explode(F.sequence(F.ceil(F.length("form") * review / 100).cast("int"), F.floor(F.length("form") * 100 / review).cast("int"))).alias("size"))
    near = asked.join(reach, ["first", "size"]).where(F.levenshtein("normalized", "form") <= F.greatest("size", F.length("form")) * (1 - review / 100) + 1e-9)
    null = F.lit(None).cast("string")
    scored = near.select("normalized", "concept_id", fuzzy_score(F.col("normalized"), F.col("form"), null, null).alias("score")).groupBy("normalized", "concept_id").agg(F.max("score").alias("score")).where(F.col("score") >= review)
    # two best of a form by a partial aggregate: the best, then the best score of the other concepts
    best = scored.groupBy("normalized").agg(F.max(F.struct("score", (-F.col("concept_id")).alias("m"))).alias("b")).select("normalized", F.col("b.score").alias("score"), (-F.col("b.m")).alias("concept_id"))
    second = scored.join(best.select("normalized", F.col("concept_id").alias("first_id")), "normalized").where(F.col("concept_id") != F.col("first_id")).groupBy("normalized").agg(F.max("score").alias("second"))
    best = best.join(second, "normalized", "left").withColumn("ambiguous", F.coalesce(F.col("score") - F.col("second") < GAP, F.lit(False)))
    fuzzy = rest.where(~F.col("acronym")).join(best, "normalized").select("id", F.when((F.col("score") >= auto) & ~F.col("ambiguous"), "fuzzy_auto").otherwise("fuzzy").alias("method"), "concept_id", "score", "ambiguous")
    return exact.union(fuzzy)


def new_suggestions(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Fuzzy matches for review that known(id, concept_id), pending or refused, doesn't hold yet."""
    return matches.where("method = 'fuzzy'").join(known.select("id", "concept_id"), ["id", "concept_id"], "left_anti")


# ---- authors, review ----


def author_masters(authors: DataFrame, links: DataFrame) -> DataFrame:
    """id, master, key of authors(id, preferred_name, normalized, status) that share a recomputed key with another: the
    master has most documents in links(document_id, author_id), then is accepted, then has the least id."""
    rows = authors.select("id", "normalized", "status", author_forms(F.col("preferred_name")).alias("f"))
    rows = rows.select("id", "status", F.when(F.col("f.valid"), F.substring("f.normalized", 1, 255)).otherwise(F.col("normalized")).alias("key"))
    docs = links.groupBy(F.col("author_id").alias("id")).agg(F.countDistinct("document_id").alias("docs"))
    rows = rows.join(docs, "id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    best = rows.groupBy("key").agg(F.max(F.struct("docs", "status", (-F.col("id")).alias("m"), "id")).alias("b"), F.count("*").alias("n")).where("n > 1").select("key", F.col("b.id").alias("master"))
    return rows.join(best, "key").select("id", "master", "key")


def review_suggestions(rows: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """The first pending ones (status 0) by id, each with the least accepted id that agrees in keys."""
    accepted = rows.where("status = 1").groupBy(*keys).agg(F.min("id").alias("suggestion"))
    first = rows.where("status = 0").orderBy("id").limit(limit)  # a page of the review queue
    return first.join(accepted, keys, "left").select("id", *keys, "suggestion")


def relinked(keywords: DataFrame, labels: DataFrame, changed: DataFrame) -> DataFrame:
    """keywords after the labels of changed(concept_id) were edited: links to these concepts stay only where a label
    still has the keyword's form, and unlinked keywords get the least concept of their form."""
    now = labels.groupBy("normalized").agg(F.min("concept_id").alias("__new"))
    still = labels.select("normalized", F.col("concept_id").alias("thesaurus_concept_id"), F.lit(True).alias("__still")).distinct()
    rows = keywords.join(still, ["normalized", "thesaurus_concept_id"], "left").join(now, "normalized", "left").join(changed.select(F.col("concept_id").alias("thesaurus_concept_id"), F.lit(True).alias("__changed")).distinct(), "thesaurus_concept_id", "left")
    lost = F.col("thesaurus_concept_id").isNull() | (F.coalesce("__changed", F.lit(False)) & F.col("__still").isNull())
    new = F.when(lost, F.col("__new")).otherwise(F.col("thesaurus_concept_id"))
    return rows.select(*(new.alias(c) if c == "thesaurus_concept_id" else F.col(c) for c in keywords.columns))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """limit rows after offset in order, with has_more and the total of all rows in each."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)  # a page
    return cut.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def term_expansion(rules: DataFrame, labels: DataFrame, concepts: DataFrame, keywords: DataFrame, variations: DataFrame) -> DataFrame:
    """group_id, position, term of rules(group_id, position, term) with, after each term, the labels of the concepts that
    it names and the active variations of keywords with its form; repeats within a group are dropped."""
    own = rules.select("group_id", "position", F.lower(F.trim("term")).alias("term")).where("term <> ''")
    named = labels.select(F.explode(F.array_distinct(F.array(F.lower("label"), F.lower("normalized")))).alias("term"), "concept_id").distinct()
    preferred = concepts.select(F.explode(F.array_distinct(F.array(F.lower("label"), F.lower("normalized")))).alias("term"), F.col("id").alias("concept_id")).distinct()
    ids = own.join(named, "term").select("group_id", "position", "term", "concept_id")
    ids = ids.union(own.join(named, "term", "left_anti").join(preferred, "term").select("group_id", "position", "term", "concept_id"))
    by_label = ids.join(labels.select("concept_id", F.lower(F.trim("label")).alias("more")), "concept_id").select("group_id", "position", "more", F.lit(1).alias("kind"))
    active = keywords.where("status = 1").select(F.col("id").alias("keyword_id"), F.col("normalized").alias("term"))
    by_variation = own.join(active, "term").join(variations.where("status = 1"), "keyword_id").select("group_id", "position", F.lower(F.trim("variation")).alias("more"), F.lit(2).alias("kind"))
    every = own.select("group_id", "position", F.col("term").alias("more"), F.lit(0).alias("kind")).union(by_label).union(by_variation).where("more <> ''")
    first = every.groupBy("group_id", "more").agg(F.min(F.struct("position", "kind")).alias("at"))
    # configuration: a group has few terms
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("at.position", "at.kind", "more")) - 1
    return first.select("group_id", rank.alias("position"), F.col("more").alias("term"))


# ---- the report of a treatment, and decisions on what it left open ----

GROUPED = ("exact_label_matched", "exact_concept_matched", "fuzzy_auto_matched")
OPEN = "fuzzy_review_required"


def grouped_terms(log: DataFrame, concepts: int = 50, terms: int = 200) -> DataFrame:
    """concept, total, place, term: the first concepts of log(id, action, concept, term) in the order of their first entry,
    each with its first terms and the number of all."""
    rows = log.where(F.col("action").isin(*GROUPED)).select("id", F.coalesce("concept", F.lit("N/A")).alias("concept"), "term")
    first = rows.groupBy("concept").agg(F.min("id").alias("first"), F.count("*").alias("total")).orderBy("first").limit(concepts)
    own = rows.join(F.broadcast(first), "concept")  # so many rows at most
    place = F.row_number().over(Window.partitionBy("concept").orderBy("id"))
    return own.withColumn("place", place).where(F.col("place") <= terms).select("concept", "total", "place", "term")


def listed_entries(log: DataFrame, action: str, limit: int = 500) -> DataFrame:
    """The first entries of one action, as the report lists them, with the number of all."""
    rows = log.where(F.col("action") == action)
    return rows.orderBy("id").limit(limit).crossJoin(rows.agg(F.count("*").alias("total")))  # one row


def decide(log: DataFrame, keywords: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, keywords) after decisions(log_id, decision, new_display) on open entries of log(id, keyword_id, action, status,
    concept_id); closed ones stay as they are. keywords has id, display, normalized and thesaurus_concept_id.

    approve gives the keyword the concept, if there is one; reject closes the entry; edit gives the keyword a new form.
    """
    form = F.nullif(F.trim("new_display"), F.lit(""))
    one = decisions.groupBy(F.col("log_id").alias("id")).agg(F.min_by(F.struct("decision", form.alias("new_display")), "decision").alias("d"))
    rows = log.join(one, "id", "left").withColumn("open", (F.col("action") == OPEN) & (F.col("status") == "pending") & F.col("d").isNotNull())
    d = F.col("d.decision")
    kind = F.when(F.col("open") & (d == "approve") & F.col("concept_id").isNotNull(), "approve").when(F.col("open") & (d == "reject"), "reject").when(F.col("open") & (d == "edit") & F.col("d.new_display").isNotNull(), "edit")
    rows = rows.withColumn("kind", kind)
    action = F.when(F.col("kind") == "approve", "manual_approved").when(F.col("kind") == "reject", "manual_rejected").when(F.col("kind") == "edit", "cleaned").otherwise(F.col("action"))
    status = F.when(F.col("kind").isin("approve", "edit"), "applied").when(F.col("kind") == "reject", "rejected").otherwise(F.col("status"))
    new_log = rows.select(*(action.alias(c) if c == "action" else status.alias(c) if c == "status" else F.col(c) for c in log.columns))
    done = rows.where(F.col("kind").isin("approve", "edit"))
    per = done.groupBy(F.col("keyword_id").alias("id")).agg(F.max_by("concept_id", F.when(F.col("kind") == "approve", F.col("id"))).alias("concept"), F.max_by("d.new_display", F.when(F.col("kind") == "edit", F.col("id"))).alias("form"))
    per = per.withColumn("plain", normalize_udf("form"))
    new = {"display": F.coalesce("form", "display"), "normalized": F.coalesce("plain", "normalized"), "thesaurus_concept_id": F.coalesce("concept", "thesaurus_concept_id")}
    return new_log, keywords.join(per, "id", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in keywords.columns))
