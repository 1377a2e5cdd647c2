"""Effective identities: project mapping, then the owner's, then the global one, then the raw id; one hop per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _layers(links: DataFrame, source: str, entity: str, mapping: DataFrame) -> tuple[DataFrame, list]:
    """links(…, project_id, owner_id) with one target column per layer."""
    rows = mapping.where(F.col("entity_type") == entity)
    layer = lambda scope, to: rows.where(F.col("scope") == scope).select(F.col("source_id").alias(source), F.col("scope_id").alias(to), F.col("target_id").alias(f"__{scope}"))
    out = links.join(layer("project", "project_id"), [source, "project_id"], "left").join(layer("user", "owner_id"), [source, "owner_id"], "left")
    out = out.join(layer("global", "__any").drop("__any"), source, "left")
    return out, [F.col("__project"), F.col("__user"), F.col("__global")]


def _of_project(links: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    owners = projects.select(F.col("id").alias("project_id"), "owner_id")
    return links.join(documents.select(F.col("id").alias("document_id"), "project_id"), "document_id").join(owners, "project_id")


def effective_authors(links: DataFrame, documents: DataFrame, projects: DataFrame, mapping: DataFrame) -> DataFrame:
    rows, layers = _layers(_of_project(links, documents, projects), "author_id", "author", mapping)
    return rows.select("document_id", "author_id", "position", F.coalesce(*layers, "author_id").alias("author"))


def effective_keywords(links: DataFrame, documents: DataFrame, projects: DataFrame, mapping: DataFrame, keywords: DataFrame) -> DataFrame:
    """The effective keyword is negative for a thesaurus concept."""
    rows, layers = _layers(_of_project(links, documents, projects), "keyword_id", "keyword", mapping)
    rows = rows.join(keywords.select(F.col("id").alias("keyword_id"), "type", "keyword_concept_id", "thesaurus_concept_id"), "keyword_id")
    own = F.when(F.col("thesaurus_concept_id").isNull(), F.coalesce("keyword_concept_id", "keyword_id")).otherwise(-F.col("thesaurus_concept_id"))
    return rows.select("document_id", "keyword_id", "type", F.coalesce(*layers, own).alias("keyword"))


def keyword_labels(keywords: DataFrame, concepts: DataFrame) -> DataFrame:
    """keyword (effective id), label: the concept's preferred label, else the keyword's display or original form."""
    return concepts.select((-F.col("id")).alias("keyword"), "label").union(keywords.select("id", F.coalesce("display", "original")))


def diverging_links(links: DataFrame, stored: DataFrame, keys: list[str], effective: str) -> DataFrame:
    """Links whose stored effective id differs from the one that the mappings give."""
    return links.join(stored.withColumnRenamed(effective, "stored"), keys).where(~F.col(effective).eqNullSafe(F.col("stored")))


def merge_mapping(mapping: DataFrame, entity: str, scope: str, scope_id: int, source_id: int, target_id: int) -> DataFrame:
    """The mapping after source is grouped into target: the target's own target counts, rows that pointed at the source
    follow, and an earlier row of the source is replaced. Grouping with itself, or a loop, raises ValueError."""
    here = (F.col("entity_type") == entity) & (F.col("scope") == scope) & (F.col("scope_id") == scope_id)
    onward = mapping.where(here & (F.col("source_id") == target_id)).select("target_id").first()
    final = onward[0] if onward else target_id
    if final == source_id:
        raise ValueError("an identity can't be grouped into itself")
    moved = mapping.withColumn("target_id", F.when(here & (F.col("target_id") == source_id), F.lit(final)).otherwise(F.col("target_id")).cast(mapping.schema["target_id"].dataType))
    kept = moved.where(~(here & (F.col("source_id") == source_id)))
    row = mapping.sparkSession.createDataFrame([(entity, scope, scope_id, source_id, final)], "entity_type string, scope string, scope_id int, source_id long, target_id long")
    return kept.unionByName(row)


def undo_mapping(mapping: DataFrame, entity: str, scope: str, scope_id: int, source_id: int) -> DataFrame:
    here = (F.col("entity_type") == entity) & (F.col("scope") == scope) & (F.col("scope_id") == scope_id)
    return mapping.where(~(here & (F.col("source_id") == source_id)))


# ---- global groupings of keywords ----


def _global(mapping: DataFrame):
    return (F.col("entity_type") == "keyword") & (F.col("scope") == "global")


def global_target(keywords: DataFrame, mapping: DataFrame, keyword_id: int) -> int:
    """The keyword's effective id by the global layer alone; negative for a concept."""
    row = mapping.where(_global(mapping) & (F.col("source_id") == keyword_id)).select("target_id").first()
    if row:
        return row[0]
    own = keywords.where(F.col("id") == keyword_id).select("keyword_concept_id", "thesaurus_concept_id").first()
    if own is None:
        raise ValueError(f"there is no keyword {keyword_id}")
    return -own[1] if own[1] is not None else own[0] if own[0] is not None else keyword_id


def merge_keywords(keywords: DataFrame, mapping: DataFrame, source_id: int, target_id: int) -> tuple[DataFrame, DataFrame]:
    """(keywords, mapping) after the source was grouped into the target for all projects.

    A keyword without a concept goes by its keyword_concept_id, with those that were grouped in it; else, or where the
    target is a concept, mapping rows are made, for its dependents with the note "via #id". Mappings to the source
    follow. ValueError for a loop or a source that is grouped elsewhere; grouping again where it is changes nothing.
    """
    a, b = (global_target(keywords, mapping, x) for x in (target_id, source_id))
    if a == source_id:
        raise ValueError("the target is grouped in the source")
    if a == b:
        return keywords, mapping
    concept = keywords.where(F.col("id") == source_id).select("thesaurus_concept_id").first()[0]
    mapped = not mapping.where(_global(mapping) & (F.col("source_id") == source_id)).isEmpty()
    if b != source_id and (mapped or concept is None):
        raise ValueError("the source is grouped elsewhere: undo that first")
    follow = mapping.withColumn("target_id", F.when(_global(mapping) & (F.col("target_id") == source_id), F.lit(a)).otherwise(F.col("target_id")).cast(mapping.schema["target_id"].dataType))
    grouped = F.col("keyword_concept_id") == source_id
    if concept is None and a > 0:
        moved = F.when(grouped | (F.col("id") == source_id), F.lit(a)).otherwise(F.col("keyword_concept_id"))
        return keywords.withColumn("keyword_concept_id", moved.cast(keywords.schema["keyword_concept_id"].dataType)), follow
    open_ = keywords.where(grouped & (F.col("id") != source_id) & F.col("thesaurus_concept_id").isNull()).join(mapping.where(_global(mapping)).select(F.col("source_id").alias("id")), "id", "left_anti").select("id", F.lit(f"via #{source_id}").alias("note"))
    rows = open_.union(keywords.where(F.col("id") == source_id).select("id", F.lit(None).cast("string")))
    new = rows.select(F.lit("keyword").alias("entity_type"), F.lit("global").alias("scope"), F.lit(0).alias("scope_id"), F.col("id").alias("source_id"), F.lit(a).cast("long").alias("target_id"), "note")
    return keywords, follow.unionByName(new, allowMissingColumns=True)


def undo_keywords(keywords: DataFrame, mapping: DataFrame, source_id: int, dependents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keywords, mapping) after the source's global grouping was undone: its mapping row and those made via it go, or
    it stands for itself again and those of dependents(id), its own before, that still point where it did are its own
    again. ValueError where there is nothing to undo."""
    at = _global(mapping) & (F.col("source_id") == source_id)
    if not mapping.where(at).isEmpty():
        via = _global(mapping) & F.col("note").eqNullSafe(f"via #{source_id}") if "note" in mapping.columns else F.lit(False)
        return keywords, mapping.where(~(at | via))
    own = keywords.where(F.col("id") == source_id).select("keyword_concept_id", "thesaurus_concept_id").first()
    if own is None or own[1] is not None or own[0] in (None, source_id):
        raise ValueError("the keyword has no global grouping")
    kind = keywords.schema["keyword_concept_id"].dataType
    rows = keywords
    back = F.col("id") == source_id
    if dependents is not None:
        rows = rows.join(dependents.select("id", F.lit(True).alias("__own")).distinct(), "id", "left")
        back = back | (F.coalesce("__own", F.lit(False)) & (F.col("keyword_concept_id") == own[0]))
    return rows.withColumn("keyword_concept_id", F.when(back, F.lit(source_id)).otherwise(F.col("keyword_concept_id")).cast(kind)).select(*keywords.columns), mapping


def merges_of_table(entities: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs(kept, dropped), refused(header, variation, reason)) of a merge table's entries(header, variations), names
    looked up in entities(id, normalized); entries are in comparison form already."""
    rows = entries.select("header", F.explode("variations").alias("variation"))
    of = lambda c: entities.groupBy(F.col("normalized").alias(c)).agg(F.min("id").alias(f"{c}_id"))
    found = rows.join(of("header"), "header", "left").join(of("variation"), "variation", "left")
    reason = F.when(F.col("header_id").isNull(), "unknown header").when(F.col("variation_id").isNull(), "unknown variation").when(F.col("header_id") == F.col("variation_id"), "same entity")
    found = found.withColumn("reason", reason)
    pairs = found.where("reason IS NULL").groupBy(F.col("variation_id").alias("dropped")).agg(F.min("header_id").alias("kept")).select("kept", "dropped")
    return pairs, found.where("reason IS NOT NULL").select("header", "variation", "reason")


def separate_variation(links: DataFrame, author_id: int, original_name: str, new_id: int) -> DataFrame:
    """links(document_id, author_id, original_name, …) with those of one written form moved to an identity of its own."""
    moved = (F.col("author_id") == author_id) & (F.col("original_name") == original_name)
    return links.withColumn("author_id", F.when(moved, F.lit(new_id)).otherwise(F.col("author_id")).cast(links.schema["author_id"].dataType))


def entity_list(entities: DataFrame, variations: DataFrame, links: DataFrame, text: str = "", only_main: DataFrame | None = None) -> DataFrame:
    """id, name, documents of entities(id, name, normalized) whose name, form or a variation(id, variation) holds the
    text; links(id, document_id). With only_main(source_id), grouped ones are left out."""
    rows = entities.select("id", "name", "normalized")
    if text:
        by_name = rows.where(F.lower("name").contains(text.lower()) | F.col("normalized").contains(text.lower())).select("id")
        rows = rows.join(by_name.union(variations.where(F.lower("variation").contains(text.lower())).select("id")).distinct(), "id", "left_semi")
    if only_main is not None:
        rows = rows.join(only_main.select(F.col("source_id").alias("id")), "id", "left_anti")
    docs = links.groupBy("id").agg(F.countDistinct("document_id").alias("documents"))
    return rows.join(docs, "id", "left").select("id", "name", F.coalesce("documents", F.lit(0)).alias("documents"))
