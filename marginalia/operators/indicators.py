"""Indicators over the documents, authors and keywords of one project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.identity import keyword_labels

def cites() -> Column:
    return F.coalesce(F.col("cited_by"), F.lit(0))


def long_sum(c: Column) -> Column:
    return F.sum(c).cast("long")


def filled_years(years: DataFrame, zero: list[str]) -> DataFrame:
    """Rows for all years between the first and the last, with zeros where there were none."""
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(years, "year", "left").na.fill(0, zero)


def annual_production(docs: DataFrame) -> DataFrame:
    per = docs.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("doc_count"), long_sum(cites()).alias("citations"))
    return filled_years(per, ["doc_count", "citations"])


def by_year() -> Window:
    return Window.orderBy("year")  # over a row a year


def growth_rate(docs: DataFrame) -> DataFrame:
    before = F.lag("doc_count").over(by_year())
    return annual_production(docs).select("year", "doc_count", F.when(before > 0, F.round((F.col("doc_count") - before) / before * 100, 1)).alias("growth"))


def annual_detail(docs: DataFrame) -> DataFrame:
    n, before = F.col("doc_count"), F.lag("doc_count").over(by_year())
    return annual_production(docs).select(
        "year", "doc_count", "citations",
        F.when(n > 0, F.round(F.col("citations") / n, 1)).otherwise(F.lit(0.0)).alias("avg_citations"),
        F.sum("doc_count").over(by_year().rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        F.when(before > 0, F.round((n - before) / before * 100, 1)).alias("growth"),
        F.when(F.row_number().over(by_year()) >= 3, F.round(F.avg("doc_count").over(by_year().rowsBetween(-2, 0)), 1)).alias("moving_avg"),
    )


def annual_kpis(docs: DataFrame) -> DataFrame:
    """Years, documents, mean per year, best year (the first of several), compound growth in percent."""
    one = annual_production(docs).agg(
        F.count("*").alias("years"), long_sum(F.col("doc_count")).alias("documents"), F.round(F.avg("doc_count"), 1).alias("avg_per_year"),
        F.min_by("year", F.struct(-F.col("doc_count"), "year")).alias("best_year"),
        F.min_by("doc_count", "year").alias("first_n"), F.max_by("doc_count", "year").alias("last_n"),
    )
    growth = F.when((F.col("years") > 1) & (F.col("first_n") > 0), F.round((F.pow(F.col("last_n") / F.col("first_n"), 1 / (F.col("years") - 1)) - 1) * 100, 1))
    return one.select("years", "documents", "avg_per_year", "best_year", growth.alias("cagr"))


def citations_per_year(docs: DataFrame) -> DataFrame:
    per = docs.where("year IS NOT NULL AND cited_by IS NOT NULL").groupBy("year").agg(
        long_sum(F.col("cited_by")).alias("citations"), F.round(F.avg("cited_by"), 2).alias("avg_citations"), F.max("cited_by").alias("max_citations"), F.count("*").alias("documents"))
    return filled_years(per, ["citations", "avg_citations", "max_citations", "documents"])


def h_index(docs: DataFrame) -> DataFrame:
    """From the number of documents per citation count, a few rows: the largest h such that h documents have h."""
    per = docs.where("cited_by IS NOT NULL").groupBy("cited_by").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("cited_by")))
    return per.select(F.least("cited_by", above).alias("h")).agg(F.coalesce(F.max("h"), F.lit(0)).cast("long").alias("h_index"))


def top_authors(pairs: DataFrame, docs: DataFrame, authors: DataFrame, limit: int = 20, by: str = "doc_count") -> DataFrame:
    per = pairs.join(docs.select(F.col("id").alias("document_id"), "cited_by"), "document_id").groupBy("author").agg(F.count("*").alias("doc_count"), long_sum(F.col("cited_by")).alias("citations"))
    top = per.orderBy(F.desc(by), "author").limit(limit)
    return top.join(authors.select(F.col("id").alias("author"), F.col("preferred_name").alias("name")), "author").select("author", "name", "doc_count", "citations")


def top_sources(docs: DataFrame, limit: int = 20) -> DataFrame:
    return (
        docs.where("source_title IS NOT NULL AND source_title <> ''").groupBy("source_title")
        .agg(F.count("*").alias("doc_count"), long_sum(F.col("cited_by")).alias("citations"), F.round(F.avg("cited_by"), 1).alias("avg_citations"))
        .orderBy(F.desc("doc_count"), "source_title").limit(limit)
    )


def top_keywords(links: DataFrame, keywords: DataFrame, concepts: DataFrame, kind: str = "author_keyword", limit: int = 50) -> DataFrame:
    """Per effective id within a type; the label is the greatest of the links' own labels."""
    own = keywords.select(F.col("id").alias("keyword_id"), "display", "keyword_concept_id", "thesaurus_concept_id")
    head = keywords.select(F.col("id").alias("keyword_concept_id"), F.col("display").alias("head"))
    rows = links.where(F.col("type") == kind).join(own, "keyword_id").join(head, "keyword_concept_id", "left")
    rows = rows.join(concepts.select(F.col("id").alias("thesaurus_concept_id"), "label"), "thesaurus_concept_id", "left")
    per = rows.groupBy("keyword").agg(F.max(F.coalesce("label", "head", "display")).alias("label"), F.countDistinct("document_id").alias("doc_count"))
    return per.orderBy(F.desc("doc_count"), "keyword").limit(limit)


def distribution(docs: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Ties: by label."""
    label = F.coalesce(F.col(column), F.lit("Unknown"))
    return docs.groupBy(column).agg(F.count("*").alias("doc_count")).select(label.alias("label"), "doc_count").orderBy(F.desc("doc_count"), "label").limit(limit)


def summary(docs: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    open_ = F.col("open_access_status").isNotNull() & ~F.col("open_access_status").isin("closed", "")
    one = docs.agg(
        F.count("*").alias("documents"), F.coalesce(long_sum(F.col("cited_by")), F.lit(0)).alias("citations"), F.round(F.avg(cites()), 2).alias("avg_citations"),
        F.countDistinct(F.when(F.col("source_title") != "", F.col("source_title"))).alias("sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.when(open_, 1)).alias("open_access"))
    return one.crossJoin(pairs.agg(F.countDistinct("author").alias("authors"))).crossJoin(words.agg(F.countDistinct("keyword").alias("keywords")))  # one row each


def collaboration_index(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    per = pairs.groupBy("document_id").agg(F.count("*").alias("n")).join(docs.select(F.col("id").alias("document_id"), "year"), "document_id")
    return per.where("year IS NOT NULL").groupBy("year").agg(F.round(F.avg("n"), 2).alias("collaboration_index"), F.count("*").alias("documents"))


def author_indices(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """author, h_index, g_index: both are the last rank of a passing prefix, so the greatest rank that passes."""
    rows = pairs.join(docs.select(F.col("id").alias("document_id"), cites().alias("cited")), "document_id")
    rank = Window.partitionBy("author").orderBy(F.desc("cited"), "document_id")
    rows = rows.select("author", "cited", F.row_number().over(rank).alias("rn"), F.sum("cited").over(rank.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    best = lambda ok: F.coalesce(F.max(F.when(ok, F.col("rn"))), F.lit(0)).cast("long")
    return rows.groupBy("author").agg(best(F.col("cited") >= F.col("rn")).alias("h_index"), best(F.col("total") >= F.col("rn") * F.col("rn")).alias("g_index"))


def lotka(pairs: DataFrame) -> DataFrame:
    seen = pairs.groupBy("author").agg(F.count("*").alias("n_docs")).groupBy("n_docs").agg(F.count("*").alias("authors"))
    one = seen.agg(F.coalesce(F.max(F.when(F.col("n_docs") == 1, F.col("authors"))), F.lit(0)).alias("a1"))  # one row
    return seen.crossJoin(one).select("n_docs", "authors", F.round(F.col("a1") / (F.col("n_docs") * F.col("n_docs")), 1).alias("expected"))


def authors_report(pairs: DataFrame, docs: DataFrame, authors: DataFrame, limit: int = 100, search: str | None = None) -> DataFrame:
    """The first authors by documents, citations, id, with h- and g-index of these alone."""
    names = authors.select(F.col("id").alias("author"), F.col("preferred_name").alias("name"))
    if search:
        names, limit = names.where(F.col("name").contains(search.strip())), 250
    rows = pairs.join(docs.select(F.col("id").alias("document_id"), cites().alias("cited"), "year"), "document_id")
    per = rows.groupBy("author").agg(F.count("*").alias("doc_count"), long_sum(F.col("cited")).alias("citations"), F.round(F.avg("cited"), 1).alias("avg_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    top = per.join(names, "author").orderBy(F.desc("doc_count"), F.desc("citations"), "author").limit(limit)
    return top.join(author_indices(pairs.join(top.select("author"), "author", "left_semi"), docs), "author")


def keywords_report(links: DataFrame, docs: DataFrame, keywords: DataFrame, concepts: DataFrame, limit: int = 150, search: str | None = None) -> DataFrame:
    rows = links.join(docs.select(F.col("id").alias("document_id"), "year"), "document_id").join(keyword_labels(keywords, concepts), "keyword")
    of = lambda kind: F.countDistinct(F.when(F.col("type") == kind, F.col("document_id")))
    rows = rows.join(keywords.select(F.col("id").alias("keyword_id"), "original"), "keyword_id")
    aggs = [F.countDistinct("document_id").alias("freq"), of("author_keyword").alias("author_freq"), of("indexed_keyword").alias("indexed_freq"), F.min("year").alias("first_year"), F.max("year").alias("last_year")]
    per = rows.groupBy("keyword", "label").agg(*aggs, F.max(F.lower("original").contains((search or "").lower())).alias("__hit"))
    if search:
        per, limit = per.where(F.lower("label").contains(search.lower()) | F.col("__hit")), 300
    kind = F.when((F.col("author_freq") > 0) & (F.col("indexed_freq") > 0), "both").when(F.col("author_freq") > 0, "author").when(F.col("indexed_freq") > 0, "indexed").otherwise("raw")
    return per.withColumn("kind", kind).drop("__hit").orderBy(F.desc("freq"), "label", "keyword").limit(limit)


def sources_report(docs: DataFrame, limit: int = 100) -> DataFrame:
    return (
        docs.where("source_title IS NOT NULL AND source_title <> ''").groupBy("source_title")
        .agg(F.max("issn").alias("issn"), F.min("qualis").alias("best_stratum"), F.count("*").alias("doc_count"), long_sum(cites()).alias("citations"))
        .orderBy(F.desc("doc_count"), F.desc("citations"), "source_title").limit(limit)
    )


def bradford(docs: DataFrame) -> DataFrame:
    """Zones of sources by documents. One row a source goes through the window; documents are summed before it."""
    per = docs.where("source_title IS NOT NULL AND source_title <> ''").groupBy("source_title").agg(F.count("*").alias("doc_count"), long_sum(cites()).alias("citations"))
    order = Window.orderBy(F.desc("doc_count"), F.desc("citations"), "source_title")
    rows = per.withColumns({"rank": F.row_number().over(order), "cumulative": F.sum("doc_count").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("doc_count").over(Window.partitionBy())})
    zone = F.when((F.col("rank") == 1) | (F.col("cumulative") <= F.round(F.col("total") * 0.33)), 1).when(F.col("cumulative") <= F.round(F.col("total") * 0.67), 2).otherwise(3)
    return rows.select("source_title", "doc_count", "citations", "cumulative", zone.alias("zone"))


def qualis_distribution(docs: DataFrame) -> DataFrame:
    """Strata in their order, those without one last."""
    order = F.array_position(F.array(*map(F.lit, ("A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "B5", "C"))), F.col("stratum"))
    per = docs.groupBy(F.coalesce("qualis", F.lit("none")).alias("stratum")).agg(F.count("*").alias("doc_count"))
    return per.withColumn("position", F.when(order > 0, order).otherwise(99).cast("int"))


def entity_report(links: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Documents, citations and mean per label; each (label, document) counts once before anything is summed."""
    pairs = links.select("document_id", key).where(F.col(key).isNotNull()).distinct()
    rows = pairs.join(docs.select(F.col("id").alias("document_id"), cites().alias("cited")), "document_id")
    return rows.groupBy(key).agg(F.count("*").alias("doc_count"), long_sum(F.col("cited")).alias("citations"), F.round(F.avg("cited"), 1).alias("avg_citations"))


def documents_report(docs: DataFrame, author_links: DataFrame, authors: DataFrame, countries: DataFrame, limit: int = 100) -> DataFrame:
    """The most cited documents, then their author and country strings: links are joined with the few top rows only."""
    top = docs.orderBy(F.desc(cites()), "id").limit(limit).select(F.col("id").alias("document_id"), "year", "source_title", cites().alias("cited"))
    names = author_string(author_links.join(top.select("document_id"), "document_id", "left_semi"), authors)
    places = countries.join(top.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("country")), ", ").alias("countries"))
    return top.join(names, "document_id", "left").join(places, "document_id", "left")


def author_string(author_links: DataFrame, authors: DataFrame) -> DataFrame:
    """Names in order of position; of several links of one effective author the first counts."""
    first = author_links.groupBy("document_id", "author").agg(F.min("position").alias("position"))
    named = first.join(authors.select(F.col("id").alias("author"), F.col("preferred_name").alias("name")), "author")
    return named.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "author", "name"))), lambda x: x["name"]), "; ").alias("authors"))


def keyword_evolution(words: DataFrame, docs: DataFrame, labels: DataFrame, ids: DataFrame, first: int, last: int) -> DataFrame:
    """ids(keyword) x years with counts, zero where there is none."""
    rows = words.select("document_id", "keyword").distinct().join(ids, "keyword", "left_semi").join(docs.select(F.col("id").alias("document_id"), "year").where(F.col("year").between(first, last)), "document_id")
    per = rows.groupBy("keyword", "year").agg(F.count("*").alias("doc_count"))
    grid = ids.select("keyword").distinct().join(labels, "keyword").select("keyword", "label", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(per, ["keyword", "year"], "left").na.fill(0, ["doc_count"])


def glossary(links: DataFrame, docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Thesaurus concepts in use: number of raw keywords behind each, documents, citations once per (concept, document)."""
    used = links.where("keyword < 0")
    variants = used.groupBy("keyword").agg(F.countDistinct("keyword_id").alias("variant_count"))
    per = entity_report(used.select("document_id", "keyword"), docs, "keyword").drop("avg_citations")
    named = concepts.select((-F.col("id")).alias("keyword"), "label", F.upper(F.substring("label", 1, 1)).alias("letter"))
    return per.join(variants, "keyword").join(named, "keyword")


def possible_repeats(docs: DataFrame, titles: DataFrame) -> DataFrame:
    rows = docs.join(titles, F.col("id") == F.col("document_id")).where("title IS NOT NULL")
    return rows.groupBy(F.md5(F.trim(F.lower("title"))).alias("title_md5"), "year").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def dedup_key(doi: Column, strict_id: Column, source: Column, external_id: Column, title: Column, year: Column) -> Column:
    """md5 of the first identity there is: DOI, strict external id, title and year, external id, title."""
    clean = F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))
    has = lambda c: c.isNotNull() & (F.trim(c) != "")
    return (
        F.when(has(doi), F.md5(F.concat(F.lit("doi:"), F.lower(F.trim(doi)))))
        .when(strict_id & has(external_id), F.md5(F.concat_ws(":", F.lit("ext"), source, external_id)))
        .when(has(title) & year.isNotNull(), F.md5(F.concat_ws(":", clean, year)))
        .when(has(external_id), F.md5(F.concat_ws(":", F.lit("ext"), source, external_id)))
        .otherwise(F.md5(F.coalesce(clean, F.lit(""))))
    )


def cities_report(links: DataFrame, docs: DataFrame, cities: DataFrame, states: DataFrame, countries: DataFrame, country_id: int | None = None) -> DataFrame:
    """Documents and citations of each city, with its state's and country's names; of one country if it is given."""
    own = cities.where(F.col("country_id") == country_id) if country_id else cities
    pairs = links.select("document_id", "city_id").distinct().join(docs.select(F.col("id").alias("document_id"), cites().alias("cited")), "document_id")
    per = pairs.groupBy("city_id").agg(F.count("*").alias("doc_count"), long_sum(F.col("cited")).alias("citations"))
    named = own.select(F.col("id").alias("city_id"), F.col("name").alias("city"), "state_id", "country_id")
    named = named.join(states.select(F.col("id").alias("state_id"), F.col("name").alias("state"), F.col("sigla").alias("state_sigla")), "state_id", "left")
    named = named.join(countries.select(F.col("id").alias("country_id"), F.col("name").alias("country"), "continent"), "country_id")
    return per.join(named, "city_id").select("city_id", "city", "state", "state_sigla", "country", "continent", "doc_count", "citations")
