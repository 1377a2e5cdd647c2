"""Institutions and places of documents from the raw parts of their affiliations.

The registers are small tables of names; each distinct raw name is looked up once and the answers are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_udf
from marginalia.operators.similarity import ranked

#: States and territories of the USA.
US_STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR GU VI AS MP".split())

#: Patterns of an address, of a US state with ZIP code and country, and of a section in a description.
ADDRESS = r"(?i)^\d+\s+[A-Za-z0-9 .\-]+$"
US_TOKEN = r"(?i)^([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?\s*(USA)?$"
SECTION = r"(?iu)(?:^|\|)\s*Categoria\s+(\d+\s*:\s*[^|\n]+)"


def is_address(c: Column) -> Column:
    """A house number with a street or other plain words; such parts name no institution."""
    return c.rlike(ADDRESS)


def _keys(names: DataFrame, *same: str) -> DataFrame:
    """names(name, …) by comparison form."""
    return names.where("trim(name) <> ''").withColumn("key", normalize_udf("name")).where("key <> ''").select("key", *same)


def _distinct_keys(raw: DataFrame) -> DataFrame:
    """raw(document_id, raw) with the comparison form, computed once for each distinct text."""
    rows = raw.select("document_id", F.trim("raw").alias("raw")).where("raw <> ''")
    forms = rows.select("raw").distinct().withColumn("key", normalize_udf("raw"))
    return rows.join(forms, "raw")


def institutions(raw: DataFrame, names: DataFrame, variations: DataFrame, organizations: DataFrame, units: DataFrame) -> DataFrame:
    """document_id, raw, kind, entity_id, institution_id for raw(document_id, raw), rows kept one by one.

    names(id, name) and variations(id, name) are institutions', organizations(id, name), units(id, name, parent). A name
    is an institution's before an organization's before a unit's, and a variation goes before a name; of equal ones the
    greatest id counts. kind is null for what isn't known; a unit has its parent as institution. Addresses are left out.
    """
    null = F.lit(None).cast("long")

    def ranked(rows: DataFrame, kind: str, rank: int, house: Column) -> DataFrame:
        return _keys(rows.select("name", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.col("id").cast("long").alias("entity_id"), house.cast("long").alias("institution_id")), "kind", "rank", "entity_id", "institution_id")

    every = ranked(variations, "institution", 4, F.col("id")).union(ranked(names, "institution", 3, F.col("id"))).union(ranked(organizations, "organization", 2, null)).union(ranked(units, "unit", 1, F.col("parent")))
    known = every.groupBy("key").agg(F.max(F.struct("rank", "entity_id", "institution_id", "kind")).alias("x")).select("key", "x.kind", "x.entity_id", "x.institution_id")
    rows = _distinct_keys(raw.where(~is_address(F.trim("raw"))))
    return rows.join(known, "key", "left").select("document_id", "raw", "kind", "entity_id", "institution_id")


def institution_links(found: DataFrame) -> DataFrame:
    return found.where("institution_id IS NOT NULL").select("document_id", "institution_id").distinct()


def places(raw: DataFrame, countries: DataFrame, states: DataFrame, cities: DataFrame, usa_id: int | None) -> DataFrame:
    """document_id, raw, country_id, state, state_id, city_id for raw(document_id, raw), rows kept one by one.

    A US token ("NY 10027 USA", "CA 95616", "TX") is of the USA and its state, if the state exists or USA is written; else
    a name is looked for among countries(id, name), then states(id, name, country_id), then cities(id, name, state_id,
    country_id), variations included as rows. Two-letter US states that don't exist bind nothing. `state` is the code of
    a known US state, for new rows where state_id is null.
    """
    rows = _distinct_keys(raw)
    code, usa = F.upper(F.regexp_extract("raw", US_TOKEN, 1)), F.regexp_extract("raw", US_TOKEN, 2)
    rows = rows.withColumn("code", F.when(code.isin(*US_STATES), code)).withColumn("us", F.coalesce(F.col("code").isNotNull() | (usa != ""), F.lit(False)))
    one = lambda t, kind, *more: _keys(t.select("name", F.col("id").cast("long").alias("id"), *more), "id", *more).groupBy("key").agg(F.max(F.struct("id", *more)).alias(kind))
    fake = (F.col("country_id") == F.lit(usa_id)) & F.col("key").rlike("^[a-z]{2}$") & ~F.upper("key").isin(*US_STATES)
    state_keys = _keys(states.select("name", F.col("id").cast("long").alias("id"), "country_id"), "id", "country_id")
    us_states = state_keys.where(F.col("country_id") == F.lit(usa_id)).groupBy(F.upper("key").alias("code")).agg(F.max("id").alias("us_state"))
    real = state_keys.where(~F.coalesce(fake, F.lit(False))).groupBy("key").agg(F.max(F.struct("id", "country_id")).alias("s"))
    out = rows.join(one(countries, "c"), "key", "left").join(real, "key", "left").join(one(cities, "t", "state_id", "country_id"), "key", "left").join(us_states, "code", "left")
    c, s, t = F.col("c.id"), F.col("s"), F.col("t")
    kind = F.when(F.col("us"), 0).when(c.isNotNull(), 1).when(s.isNotNull(), 2).when(t.isNotNull(), 3)
    pick = lambda us, country, state, city: F.when(kind == 0, us).when(kind == 1, country).when(kind == 2, state).when(kind == 3, city).cast("long")
    none = F.lit(None).cast("long")
    return out.select(
        "document_id", "raw", pick(F.lit(usa_id), c, s["country_id"], t["country_id"]).alias("country_id"), F.col("code").alias("state"),
        pick(F.col("us_state"), none, s["id"], t["state_id"]).alias("state_id"), pick(none, none, none, t["id"]).alias("city_id"),
    )


def unresolved(found: DataFrame, known: Column, limit: int = 100) -> DataFrame:
    """The raw names that stay unknown and how often, the most frequent first."""
    return found.where(~known).groupBy("raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw").limit(limit)  # a report's top


# ---- entities ----


def merge_entity(links: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Distinct links after each pairs(kept, dropped) entity went into the other."""
    rows = links.join(pairs.select(F.col("dropped").alias(column), F.col("kept").alias("__kept")), column, "left")
    return rows.select(*(F.coalesce("__kept", column).alias(c) if c == column else F.col(c) for c in links.columns)).distinct()


def copy_project(documents: DataFrame, links: dict[str, DataFrame], mapping: DataFrame, old: int, new: int, first_id: int) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(documents, links, mapping rows) of a copy of a project: new ids from first_id on in the order of the old ones."""
    own = ranked(documents.where(F.col("project_id") == old).select(F.col("id").alias("old_id")), "rank")
    ids = own.select("old_id", (F.col("rank") + first_id - 1).cast("long").alias("new_id"))
    docs = documents.where(F.col("project_id") == old).join(ids, F.col("id") == F.col("old_id")).select(*(F.col("new_id").alias(c) if c == "id" else F.lit(new).alias(c) if c == "project_id" else F.col(c) for c in documents.columns))
    moved = {k: t.join(ids, F.col("document_id") == F.col("old_id")).select(*(F.col("new_id").alias(c) if c == "document_id" else F.col(c) for c in t.columns)) for k, t in links.items()}
    rows = mapping.where((F.col("scope") == "project") & (F.col("scope_id") == old)).withColumn("scope_id", F.lit(new).cast(mapping.schema["scope_id"].dataType))
    return docs, moved, rows


def color_board(groups: DataFrame, assigned: DataFrame) -> DataFrame:
    """Documents and groups per color and section of normal groups(id, type, color, description); a section is what
    follows "Categoria N:" in the description."""
    found = F.regexp_extract(F.coalesce("description", F.lit("")), SECTION, 1)
    section = F.nullif(F.regexp_replace(F.trim(found), r"^(\d+)\s*:\s*", "$1. "), F.lit(""))
    color = F.lower(F.trim(F.coalesce(F.nullif("color", F.lit("")), F.lit("#4f8ef7"))))
    docs = assigned.groupBy("group_id").agg(F.countDistinct("document_id").alias("docs"))
    rows = groups.where("type = 'normal'").select(F.col("id").alias("group_id"), color.alias("color"), section.alias("section")).join(docs, "group_id", "left")
    return rows.groupBy("color", "section").agg(F.count("*").alias("groups"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))
