"""Readers of further exports: theses, journal baskets, database searches, works tables.

All read by Spark's sources and take fields apart with column functions; only entities are decoded in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import doi_of, entities, first_issn, safe_url, without_tags, year_of
from marginalia.sources.records import _cell, _csv, ris_rows, all_of, bare, country_of, first_of, institution_of, read_wos, record, ris_record

#: Sources whose external id identifies a record by itself, before title and year.
STRICT_SOURCES = ("bdtd", "brapci", "lista", "openalex")
#: What the thesis library writes for a missing value, and its codes.
NOT_INFORMED = "não informado pela instituição"
THESIS_TYPES = {"masterThesis": "Dissertação (mestrado)", "doctoralThesis": "Tese (doutorado)"}
THESIS_ACCESS = {"openAccess": "Open Access", "embargoedAccess": "Embargoed", "restrictedAccess": "Closed"}
THESIS_LANGUAGES = {"pt_br": "por", "pt": "por", "pt-br": "por", "en_us": "eng", "en": "eng", "es": "spa", "it": "ita", "fr": "fra"}
SEARCH_LANGUAGES = {"portuguese": "por", "english": "eng", "spanish": "spa", "french": "fre"}
BASKET_HANDLE = "https://hdl.handle.net/20.500.11959/brapci/"
EXCEL_CELL = 30_000
#: The names that each field of a works table has had.
WORKS_COLUMNS = {
    "id": ("work id", "id"), "title": ("title", "display_name"), "doi": ("doi",), "year": ("year", "publication_year"), "date": ("date", "publication_date"), "type": ("type",), "language": ("language",),
    "authors": ("author", "authorships.author.display_name", "author_names"), "institutions": ("institution", "authorships.institutions.display_name", "author_institution_names"),
    "countries": ("country", "authorships.countries"), "source": ("source", "primary_location.source.display_name", "primary_location_display_name"),
    "issn": ("issn", "primary_location.source.issn_l", "primary_location.source.issn", "primary_location_issn_l", "primary_location_issns"), "volume": ("volume", "biblio.volume", "biblio_volume"),
    "issue": ("issue", "biblio.issue", "biblio_issue"), "first_page": ("first page", "biblio.first_page", "biblio_first_page"), "last_page": ("last page", "biblio.last_page", "biblio_last_page"),
    "cited_by": ("citation count", "cited_by_count"), "oa_status": ("open access status", "open_access.oa_status", "oa_status"), "oa": ("open access", "open_access.is_oa", "is_oa"),
    "keywords": ("keyword", "keywords.display_name"), "cites": ("cites", "referenced_works"), "abstract": ("abstract",),
}


def strict_identity(records: DataFrame) -> Column:
    """Whether a record's external id alone identifies it."""
    return F.col("source").isin(*STRICT_SOURCES) & F.col("external_id").isNotNull()


def _known(values: dict[str, str], c: Column) -> Column:
    """The value for c, or c itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c], c)


def _full(c: Column, *missing: str) -> Column:
    """Trimmed; null if empty or one of the words for a missing value."""
    c = bare(c)
    return F.when((c != "") & ~F.lower(c).isin(*missing), c) if missing else F.when(c != "", c)


def _whole_year(c: Column) -> Column:
    return F.when(bare(c).rlike(r"\A\d{4}\z"), bare(c).cast("int"))


def _first_kept(c: Column, keep) -> Column:
    return F.get(F.filter(c, keep), F.lit(0))


_is_url = lambda x: x.rlike("(?i)^https?://")
_is_doi_url = lambda x: x.rlike(r"(?i)^https?://(dx\.)?doi\.org/")


# ---- theses ----


def _thesis(rows: DataFrame, **f: Column) -> DataFrame:
    """Records of theses. The id is a digest of author, title, year and links; of equal ones the n-th gets #n."""
    value = lambda c: _full(c, NOT_INFORMED)
    text = lambda c: _full(F.regexp_replace(F.regexp_replace(entities(value(c)), r"(?i)\A\s*\[[a-z]{2}\]\s*", ""), r"\s+", " "))
    parts = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|\|"), bare)
    null = F.lit(None).cast("string")
    urls = F.filter(F.transform(F.split(F.coalesce(f["link"], F.lit("")), r"\|\||;\s"), bare), _is_url)
    digest = F.sha1(F.concat_ws("\x1f", *(F.coalesce(x, F.lit("")) for x in (value(f["author"]), value(f["title"]), bare(f["year"]))), F.array_join(urls, "|")))
    name = _first_kept(parts(f["author"]), lambda x: value(x).isNotNull() & ~x.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & ~_is_url(x) & ~x.contains("@") & x.rlike(r"\p{L}.*\p{L}"))
    name = bare(F.regexp_replace(F.regexp_replace(name, r",\s*\d{4}-(\d{4})?\.?\s*$", ""), r"\s*\[[^\]]+\]\s*$", ""))
    doi_url = _first_kept(urls, lambda x: _is_doi_url(x) & doi_of(x).isNotNull())
    house = bare(F.regexp_replace(text(f.get("institution", null)), r"\s*\([^()]+\)\s*$", ""))
    country = value(f["country"]) if "country" in f else null
    country = F.when(country.isNull() | F.lower(country).isin("brasil", "br", "brazil"), "Brasil").otherwise(country) if "country" in f else null
    language = F.lower(_first_kept(parts(f.get("language", null)), lambda x: value(x).isNotNull()))
    subjects = F.transform(F.filter(F.flatten(F.array(*(parts(entities(s)) for s in f["subjects"]))), lambda x: value(x).isNotNull()), lambda x: bare(F.regexp_replace(x, r"(?i)^\[[a-z]{2}\]\s*", ""))) if "subjects" in f else F.array().cast("array<string>")
    out = rows.select(
        "__order", F.concat(F.lit("bdtd:"), digest).alias("digest"), F.array(name).alias("author_names"), text(f["title"]).alias("title"), _whole_year(value(f["year"])).alias("year"), _known(THESIS_TYPES, value(f.get("type", null))).alias("type"),
        _known(THESIS_LANGUAGES, language).alias("language"), _full(without_tags(text(f.get("abstract", null)))).alias("abstract"), safe_url(F.coalesce(_first_kept(urls, lambda x: ~_is_doi_url(x)), doi_url)).alias("url"), doi_of(doi_url).alias("doi"),
        _known(THESIS_ACCESS, value(f.get("access", null))).alias("access"), house.alias("house"), country.alias("country"), subjects.alias("subjects"),
    )
    # a digest is shared by repeats of one thesis only, so no window partition is large; the order is that of the file
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("__order"))
    out = out.withColumn("external_id", F.when(nth > 1, F.concat("digest", F.lit("#"), nth.cast("string"))).otherwise(F.col("digest")))
    c = F.col
    return record(
        out, source=F.lit("bdtd"), external_id=c("external_id"), title=c("title"), abstract=c("abstract"), year=c("year"), document_type=c("type"), doi=c("doi"), url=c("url"), language=c("language"), publisher=c("house"),
        open_access_status=c("access"), author_names=c("author_names"), author_keywords=unique_by_case(c("subjects")), countries=F.array(c("country")), institutions=F.array(c("house")),
    )


def unique_by_case(c: Column) -> Column:
    """The list with the first of the values that differ in case only."""
    return F.aggregate(c, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.array_append(got, x)))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__order", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")))


def read_thesis_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _ordered(_csv(spark, path))
    c = lambda *n: _cell(rows, *n)
    return _thesis(
        rows, author=c("Autor(a)"), title=c("Título"), year=c("Ano de defesa"), link=c("Link de acesso"), type=c("Tipo de documento"), language=c("Idioma"), abstract=F.coalesce(_full(c("Resumo em Português"), NOT_INFORMED), c("Resumo")),
        institution=c("Instituição de defesa"), country=c("País da instituição de defesa"), subjects=[c("Assuntos em português"), c("Assuntos em inglês")], access=c("Tipos de acesso"),
    )


def read_thesis_ris(spark: SparkSession, path: str) -> DataFrame:
    rows = _ordered(ris_rows(spark, path))
    joined = lambda t: F.array_join(all_of(t), "||")
    return _thesis(rows, author=joined("AU"), title=first_of("TI"), year=first_of("PY"), link=first_of("UR"), type=first_of("TY"), language=joined("LA"), abstract=first_of("AB"))


# ---- baskets of journal articles ----


def read_basket_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a numeric ID. A DOI that several IDs of the file have belongs to none of them."""
    rows = _csv(spark, path)
    value = lambda n: _full(_cell(rows, n), "null")
    text = lambda n: _full(F.regexp_replace(entities(value(n)), r"\s+", " "))
    parts = lambda n: F.split(text(n), ";")
    after = lambda mark: _full(F.regexp_extract(text("LEGEND"), rf",\s*{mark}\.\s*([^,]*?)\s*(?:,|$)", 1))
    got = rows.select(
        value("ID").alias("id"), value("CLASS").alias("kind"), _whole_year(value("YEAR")).alias("year"), text("PUBLICATION").alias("journal"), text("TITLE").alias("title"), parts("AUTHORS").alias("authors"), parts("KEYWORDS").alias("keywords"),
        _full(without_tags(text("ABSTRACTS"))).alias("abstract"), after("v").alias("volume"), _full(F.regexp_replace(after("n"), r"(?i)^(n[ºo°]\.?|no\.?|número)\s*", "")).alias("issue"), F.when(_is_doi_url(value("URL")), doi_of(value("URL"))).alias("doi"),
    ).where(F.col("id").rlike(r"\A\d+\z"))
    shared = got.where("doi IS NOT NULL").groupBy("doi").agg((F.min("id") != F.max("id")).alias("shared"))
    got = got.join(shared, "doi", "left")
    c = F.col
    return record(
        got, source=F.lit("brapci"), external_id=c("id"), title=F.when(~c("title").rlike(r"(?i)^::\s*sem t[ií]tulo\s*::$"), c("title")), abstract=c("abstract"), year=c("year"), document_type=c("kind"),
        doi=F.when(~c("shared") & (c("kind") == "Article"), c("doi")), url=F.concat(F.lit(BASKET_HANDLE), "id"), source_title=F.when(~F.upper("journal").isin("LIVRO", "CAPITULO DE LIVRO", "CAPÍTULO DE LIVRO"), c("journal")), volume=c("volume"), issue=c("issue"),
        author_names=F.transform(F.transform("authors", bare), lambda x: F.regexp_replace(x, r"(?i)\s*\((org|orgs|coord|ed|eds)\.?\)\s*$", "")), author_keywords=c("keywords"),
    )


def read_basket_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS of a basket: the id is the last part of the record's handle."""
    rows = ris_rows(spark, path)
    handle = F.regexp_extract(F.coalesce(_first_kept(all_of("UR"), lambda x: x.startswith(BASKET_HANDLE)), F.lit("")), r"(\d+)\s*$", 1)
    rows = rows.withColumn("__id", F.nullif(handle, F.lit("")))
    # the common fields come from the RIS record; the id goes through a field of its own
    known = rows.withColumn("fields", F.when(F.col("__id").isNull(), F.col("fields")).otherwise(F.concat(F.array(F.struct(F.lit("ID").alias("tag"), F.col("__id").alias("value"))), "fields")))
    return ris_record(known, "brapci")


# ---- database searches ----


def read_search_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exports of a host of databases: fixed columns, lists apart by ;, dates as yyyymmdd."""
    rows = _csv(spark, path)
    c = lambda n: _full(_cell(rows, n))
    items = lambda n: F.filter(F.transform(F.split(c(n), ";"), bare), lambda x: x != "")
    plink = F.regexp_extract(F.lower(F.coalesce(c("plink"), F.lit(""))), r"([0-9a-f-]{36})\s*$", 1)
    own = F.when(c("accessionNumber").isNotNull(), F.concat(F.coalesce(F.concat(F.lower(c("shortDbName")), F.lit(":")), F.lit("")), c("accessionNumber"))).when(plink != "", F.concat(F.lit("plink:"), plink))
    date = c("publicationDate")
    language = bare(F.get(F.split(c("language"), ";"), F.lit(0)))
    return record(
        rows, source=F.lit("lista"), external_id=own, title=F.regexp_replace(bare(entities(c("title"))), r"(?<!\.)\.$", ""), abstract=without_tags(entities(c("abstract"))),
        year=F.when(date.rlike(r"^\d{8}$"), F.substring(date, 1, 4).cast("int")).otherwise(year_of(F.coalesce(date, c("coverDate")))), document_type=F.coalesce(F.get(items("docType"), F.lit(0)), F.get(items("pubType"), F.lit(0)), c("isiType")),
        doi=doi_of(c("doi")), issn=first_issn(c("issn")), url=safe_url(c("plink")), language=F.coalesce(F.create_map(*(F.lit(x) for kv in SEARCH_LANGUAGES.items() for x in kv))[F.lower(language)], language), source_title=entities(c("source")),
        volume=c("volume"), issue=c("issue"), page_start=c("pageStart"), page_end=c("pageEnd"), publisher=c("publisher"), author_names=items("authors"), author_keywords=items("keywords"), indexed_keywords=items("subjects"),
    )


# ---- works tables ----


def work_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(W\d+)\s*$", 1), F.lit(""))


def open_access(status: Column) -> Column:
    return F.concat(F.upper(F.substring(status, 1, 1)), F.lower(F.substring(status, 2, 100)))


def read_works_csv(spark: SparkSession, path: str) -> DataFrame:
    """Works tables of any generation of column names; ValueError if there is neither an id nor a DOI column."""
    rows = _csv(spark, path)
    own = {c.strip().lstrip("﻿").lower() for c in rows.columns}
    if not own & {*WORKS_COLUMNS["id"], *WORKS_COLUMNS["doi"]}:
        raise ValueError("the table has neither a work id nor a DOI column: export it again with both")
    c = lambda field: _full(_cell(rows, *WORKS_COLUMNS[field]))
    items = lambda field: F.array_distinct(F.filter(F.transform(F.split(c(field), r"\|"), bare), lambda x: x != ""))
    cites = items("cites")
    cites = F.when(F.length(c("cites")) >= EXCEL_CELL, F.slice(cites, 1, F.greatest(F.size(cites) - 1, F.lit(0)))).otherwise(cites)  # the last one is cut
    doi, work = doi_of(c("doi")), work_id(c("id"))
    status = F.when(c("oa_status").isNotNull(), open_access(c("oa_status"))).when(F.lower(c("oa")).isin("open access", "true", "is oa"), "Open Access").when(c("oa").isNotNull(), "Closed")
    return record(
        rows, source=F.lit("openalex"), external_id=work, title=without_tags(entities(c("title"))), abstract=without_tags(entities(c("abstract"))), year=F.coalesce(_whole_year(c("year")), year_of(c("date"))), document_type=c("type"), doi=doi,
        issn=_first_kept(F.transform(items("issn"), first_issn), lambda x: x.isNotNull()), url=F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://openalex.org/"), work)), language=c("language"), source_title=c("source"),
        volume=c("volume"), issue=c("issue"), page_start=c("first_page"), page_end=c("last_page"), cited_by=F.when(c("cited_by").rlike(r"\A\d+\z"), c("cited_by").cast("int")), open_access_status=status,
        author_names=F.filter(items("authors"), lambda x: x.rlike(r"\p{L}.*\p{L}")), indexed_keywords=items("keywords"), references=F.transform(cites, work_id), countries=items("countries"), institutions=items("institutions"),
    )


def read_works_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS of works: affiliations in C1, types in lower case."""
    rows = ris_rows(spark, path)
    flat = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    places = F.array_distinct(F.transform(all_of("C1"), flat))
    parts = F.transform(F.flatten(F.transform(places, lambda x: F.split(x, ";"))), bare)
    out = ris_record(rows.withColumn("__places", places).withColumn("__parts", parts), "openalex", keep=("__places", "__parts"))
    return out.select(
        *(F.lower("document_type").alias(c) if c == "document_type" else F.col("__places").alias(c) if c == "affiliations" else F.array_distinct(F.array_compact(F.transform("__parts", country_of))).alias(c) if c == "countries"
          else F.array_distinct(F.array_compact(F.transform("__parts", institution_of))).alias(c) if c == "institutions" else F.col(c) for c in out.columns if not c.startswith("__"))
    )


def read_works_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Tagged text of works: citations in CT where TC is missing, bare work ids, types in lower case."""
    rows = read_wos(spark, path)
    return rows.withColumns({"source": F.lit("openalex"), "external_id": work_id(F.col("external_id")), "document_type": F.lower("document_type"), "open_access_status": open_access(F.col("open_access_status"))})
