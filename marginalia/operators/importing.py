"""Import: repeats, links, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.similarity import ranked
from marginalia.sources.store import stored


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with the id that is kept of its key: the first one. The first ids are found by a partial aggregate, so
    a key that many rows share is no single task's work."""
    first = rows.groupBy(key).agg(F.min(order).alias("kept"))
    return rows.join(first, key).select(order, "kept", F.when(F.col(order) == F.col("kept"), "imported").otherwise("hash").alias("outcome"))


def identities(records: DataFrame) -> DataFrame:
    """records(id, doi, source, external_id, title, year, strict) as (id, doi, source, strict, hash, title_year, kind): kind
    tells whether the DOI, the title with the year, or the source's own id is the identity. Empty strings are null."""
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    rows = records.select("id", full("doi").alias("doi"), F.lower(F.trim("source")).alias("source"), full("external_id").alias("external_id"), full("title").alias("title"), "year", (F.coalesce("strict", F.lit(False)) & full("external_id").isNotNull()).alias("strict"))
    title = F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ")
    titled = F.when(F.coalesce("year", F.lit(0)) != 0, F.md5(F.concat_ws(":", title, "year")))
    rows = rows.withColumn("title_year", F.when(F.col("title").isNotNull(), titled))
    own = F.md5(F.concat(F.lit("ext:"), "source", F.lit(":"), F.trim("external_id")))
    hashed = (
        F.when(F.col("doi").isNotNull(), F.md5(F.concat(F.lit("doi:"), F.lower(F.trim("doi"))))).when(F.col("strict"), own)
        .otherwise(F.coalesce("title_year", own, F.md5(F.concat(F.lit("title:"), title))))
    )
    rows = rows.withColumn("hash", hashed)
    kind = F.when(F.col("doi").isNotNull(), "doi").when(F.col("hash") == F.col("title_year"), "title").otherwise("ext")
    return rows.select("id", "doi", "source", "strict", "hash", "title_year", kind.alias("kind"))


def import_outcomes(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, outcome, kept of an import of rows (identities, in the order of their ids): imported, or the reason why a
    record is left out, doi or hash, and the record or document that it repeats.

    A record repeats an accepted one of the same DOI or hash; else the first accepted one of its title and year, unless
    both have a DOI: a record with a strict id if that one is from another source or known by its title, any other record
    if that one is known by its source's id. known are the documents that are there already, with ids below all others; a
    true `own` marks those of an earlier run of this import: the first record that meets one is `again`.

    What is accepted depends on earlier records only. So all are taken as accepted first and judged by what was accepted
    before, again and again until nothing changes: as many rounds as records depend on one another, mostly two or three.
    Each round takes the first accepted record per hash and per title and year by partial aggregates; no group of equal
    titles comes together.
    """
    columns = ["id", "doi", "source", "strict", "hash", "title_year", "kind"]
    every = rows.select(*columns, F.lit(False).alias("known"), F.lit(False).alias("own"))
    if known is not None:
        every = every.unionByName(known.select(*columns, F.lit(True).alias("known"), F.coalesce("own", F.lit(False)).alias("own")))
    state, told = stored(every.withColumn("accepted", F.lit(True)), "import"), None
    while True:
        held = state.where("accepted")
        by_hash = held.groupBy("hash").agg(F.min(F.struct("id", "own")).alias("h"))
        by_title = held.where("title_year IS NOT NULL").groupBy("title_year").agg(F.min(F.struct("id", "source", "kind", F.col("doi").isNotNull().alias("has_doi"))).alias("t"))
        joined = state.join(by_hash, "hash", "left").join(by_title, "title_year", "left")
        repeats = (F.col("h.id") < F.col("id")) & F.col("hash").isNotNull()
        like = F.when(F.col("strict"), (F.col("t.source") != F.col("source")) | (F.col("t.kind") == "title")).otherwise(F.col("t.kind") == "ext")
        titled = (F.col("t.id") < F.col("id")) & ~(F.col("doi").isNotNull() & F.col("t.has_doi")) & like
        judged = joined.withColumn("repeats", F.coalesce(repeats, F.lit(False)) & ~F.col("known")).withColumn("titled", F.coalesce(titled, F.lit(False)) & ~F.col("known") & ~F.col("repeats"))
        state = stored(judged.select(*columns, "known", "own", (~F.col("repeats") & ~F.col("titled")).alias("accepted"), F.when(F.col("repeats"), F.col("h.id")).when(F.col("titled"), F.col("t.id")).alias("kept"), (F.col("repeats") & F.col("h.own")).alias("mine")), "import")
        now = state.agg(F.count_if("accepted"), F.sum(F.when(F.col("accepted"), F.xxhash64("id").cast("decimal(38,0)")))).first()
        if now == told:
            break
        told = now
    dois = state.where("accepted AND doi IS NOT NULL").groupBy("doi").agg(F.min("id").alias("doi_id"))
    first = state.where("mine").groupBy("kept").agg(F.min("id").alias("first_id"))
    out = state.where("NOT known").join(dois, "doi", "left").join(first, "kept", "left")
    outcome = F.when(F.col("accepted"), "imported").when(F.col("mine") & (F.col("first_id") == F.col("id")), "again").when(F.col("doi_id") < F.col("id"), "doi").otherwise("hash")
    return out.select("id", outcome.alias("outcome"), F.coalesce("kept", "id").alias("kept"))


def resolve(names: DataFrame, known: DataFrame, form: list[str]) -> DataFrame:
    """id, is_new and the row of each distinct form of names(document_id, position, form columns, …): the id of the known
    identity of that form, else a new one above all known ids, in the order in which the forms first appear (by document and
    position; those that appear at the same place by form). The names' other columns are those of the first appearance."""
    rest = [c for c in names.columns if c not in form]
    first = names.groupBy(*form).agg(F.min(F.struct("document_id", "position", *(c for c in rest if c not in ("document_id", "position")))).alias("first"))
    found = first.join(known.select("id", *form), form, "left")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))
    new = found.where("id IS NULL").select(F.struct("first.document_id", "first.position", *form).alias("at"))
    ids = ranked(stored(new, "resolve"), "rank").crossJoin(F.broadcast(top)).select(*(F.col(f"at.{c}").alias(c) for c in form), (F.col("rank") + F.col("top")).cast("long").alias("new_id"))  # one row
    return found.join(ids, form, "left").select(F.coalesce("id", "new_id").cast("long").alias("id"), F.col("id").isNull().alias("is_new"), *form, *(F.col(f"first.{c}").alias(c) for c in rest))


def replace_links(links: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """links(document_id, …) with those of the documents(document_id) replaced by new ones; documents without new links
    lose theirs."""
    gone = documents.select("document_id").distinct()
    return links.join(gone, "document_id", "left_anti").select(*links.columns).unionByName(new.join(gone, "document_id", "left_semi").select(*links.columns))


def keyword_links(rows: DataFrame) -> DataFrame:
    """One link per document and term; an author keyword (kind 0) goes before an indexed one."""
    term = F.lower(F.trim("term"))
    rank = F.row_number().over(Window.partitionBy("document_id", "term").orderBy("kind", "position", "keyword_id"))
    return rows.withColumn("term", term).withColumn("rn", rank).where("rn = 1").drop("rn").select("document_id", "term", "kind", "position", "keyword_id")


def plain_issn(c: Column) -> Column:
    return F.translate(F.lower(c), "- ", "")


def journal_strata(docs: DataFrame, journals: DataFrame) -> DataFrame:
    """The stratum of each document's journal, null where there is none. Of several rows of one ISSN the least stratum."""
    one = journals.groupBy(plain_issn(F.col("issn")).alias("__issn")).agg(F.min("stratum").alias("stratum"))
    return docs.join(one, plain_issn(docs["issn"]) == F.col("__issn"), "left").drop("__issn")


def missing_journals(docs: DataFrame, journals: DataFrame) -> DataFrame:
    seen = docs.where("issn IS NOT NULL").select(plain_issn(F.col("issn")).alias("issn")).distinct()
    return seen.join(journals.select(plain_issn(F.col("issn")).alias("issn")), "issn", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with the rows of new in place of those of equal keys; of new's equal keys the first by order."""
    first = new.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rn = 1").drop("__rn").select(*old.columns)
    return old.join(first, keys, "left_anti").select(*old.columns).unionByName(first)


def merge_documents(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """docs after each pairs(kept, dropped): nulls filled from the dropped one, the greater citation count, one row."""
    other = pairs.join(docs.withColumnRenamed("id", "dropped"), "dropped")
    gathered = other.groupBy(F.col("kept").alias("id")).agg(*(F.max(c).alias(f"__{c}") if c == "cited_by" else F.min_by(c, F.when(F.col(c).isNotNull(), F.col("dropped"))).alias(f"__{c}") for c in docs.columns if c != "id"))
    kept = docs.join(pairs.select(F.col("dropped").alias("id")), "id", "left_anti").join(gathered, "id", "left")
    value = lambda c: F.greatest(c, f"__{c}") if c == "cited_by" else F.coalesce(c, f"__{c}")
    return kept.select(*(F.col("id") if c == "id" else value(c).alias(c) for c in docs.columns))
