"""The canonical bibliographic record and the readers of export files.

Every reader gives the columns of RECORD. Files are read by Spark's own sources: tagged text is cut into records by the
reader's record separator, so that a large file is many tasks' work, and fields are taken apart by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions.text import doi_of, first_issn, year_of

SCALARS = ("source", "external_id", "title", "abstract", "year", "document_type", "doi", "issn", "url", "language", "source_title", "volume", "issue", "page_start", "page_end", "publisher", "cited_by", "open_access_status")
LISTS = ("author_names", "author_keywords", "indexed_keywords", "affiliations", "references", "countries", "institutions")
NUMBERS = ("year", "cited_by")
#: Stems that mark the part of an affiliation that names an institution.
INSTITUTION_STEMS = ("universi", "colleg", "institut", "school", "hospital", "center", "centre", "clinic", "laboratory", "lab", "foundation", "fundacao", "embrapa", "cnpq", "usp", "unicamp", "unesp", "ufscar")


def bare(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def record(rows: DataFrame, keep: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """The columns of RECORD; what isn't given is null or an empty list, empty strings are null. Then those to keep."""
    def one(c: str) -> Column:
        kind = "array<string>" if c in LISTS else "int" if c in NUMBERS else "string"
        got = fields.get(c, F.lit(None)).cast(kind)
        if c in LISTS:
            return F.coalesce(F.array_distinct(F.filter(F.transform(got, bare), lambda x: x.isNotNull() & (x != ""))), F.array().cast(kind)).alias(c)
        return (got if c in NUMBERS else F.nullif(bare(got), F.lit(""))).alias(c)

    return rows.select(*map(one, (*SCALARS, *LISTS)), *keep)


def listed(c: Column, sep: str) -> Column:
    return F.split(c, sep)


# ---- affiliations ----


#: Fixed value: a US state with a ZIP code and the country's name.
US_PLACE = r"(?i)^[A-Z]{2}\s+\d{5}(?:-\d{4})?\s+(USA|US|U\.S\.A\.)$"


def country_of(affiliation: Column) -> Column:
    """The last part between commas, unless it is shorter than three letters; a US state and ZIP code give USA."""
    last = bare(F.element_at(F.split(affiliation, ","), -1))
    us = last.rlike(US_PLACE)
    return F.when(us, "USA").when(F.lower(last) == "peoples r china", "China").when(F.length(last) > 2, last)


def institution_of(affiliation: Column) -> Column:
    """The first part that holds a stem and has 4 to 99 letters."""
    parts = F.transform(F.split(affiliation, ","), lambda x: F.regexp_replace(bare(x), r"\s+", " "))
    stems = "|".join(INSTITUTION_STEMS)
    return F.get(F.filter(parts, lambda x: F.lower(x).rlike(stems) & F.length(x).between(4, 99)), F.lit(0))


# ---- tagged text ----


def tagged(text: Column, tag: str, sep: str) -> Column:
    """array<struct<tag, value>> of a record; a line without a tag continues the value before it."""
    clean = F.regexp_replace(F.regexp_replace(text, "\\A\ufeff", ""), "\r\n|\r", "\n")
    lines = F.split(F.concat(F.lit("\n"), clean), rf"\n(?={tag}{sep})")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, rf"\A({tag}){sep}", 1)).alias("tag"), bare(F.regexp_replace(x, rf"\A{tag}{sep}", "")).alias("value")))
    return F.filter(pairs, lambda x: x["tag"] != "")


def all_of(*tags: str) -> Column:
    return F.transform(F.filter("fields", lambda x: x["tag"].isin(*tags)), lambda x: x["value"])


def first_of(*tags: str) -> Column:
    """The first value of the first of the tags that has one."""
    return F.coalesce(*(F.get(F.filter(all_of(t), lambda x: x != ""), F.lit(0)) for t in tags))


def cut(lines: DataFrame, mark: str, tag: str, sep: str, opens: str = "") -> DataFrame:
    """fields of each record of rows of text that were split at "\\n" + mark; where lines end with a carriage return alone
    the text is split here. Bytes that are no UTF-8 become the replacement character. `opens` is put before a record whose mark was cut off."""
    text = F.regexp_replace(F.make_valid_utf8("value"), "\\A\ufeff", "")
    if opens:
        text = F.when(text.startswith(opens), text).otherwise(F.concat(F.lit(opens), text))
    records = F.explode(F.split(text, rf"\r(?!\n){'(?=' if opens else ''}{mark}{')' if opens else '(?![A-Za-z0-9])'}"))
    return lines.select(records.alias("record")).select(tagged(F.col("record"), tag, sep).alias("fields")).where(F.size("fields") > 0)


def _records(spark: SparkSession, path: str, mark: str, tag: str, sep: str, opens: str = "") -> DataFrame:
    return cut(spark.read.option("lineSep", "\n" + mark).text(path), mark, tag, sep, opens)


RIS_END, RIS_TAG, RIS_SEP = "ER  -", "[A-Z][A-Z0-9]", " {1,2}- ?"


def ris_fields(lines: DataFrame) -> DataFrame:
    """fields of RIS records: what stands before a record's type is dropped, and a new type opens a new record."""
    rows = cut(lines, RIS_END, RIS_TAG, RIS_SEP)
    at = F.filter(F.transform("fields", lambda x, i: F.when(x["tag"] == "TY", i)), lambda i: i.isNotNull())
    rows = rows.select("fields", F.posexplode(at).alias("k", "begin"), at.alias("at"))
    end = F.coalesce(F.get("at", F.col("k") + 1), F.size("fields"))
    return rows.select(F.slice("fields", F.col("begin") + 1, end - F.col("begin")).alias("fields"))


def ris_rows(spark: SparkSession, path: str) -> DataFrame:
    return ris_fields(spark.read.option("lineSep", "\n" + RIS_END).text(path))


def read_ris(spark: SparkSession, path: str, source: str = "ris") -> DataFrame:
    """RIS with any line ends; an open record at the end of the file counts."""
    return ris_record(ris_rows(spark, path), source)


def ris_record(rows: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    flat = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    return record(
        rows, keep, source=F.lit(source), external_id=first_of("ID", "AN"), title=flat(first_of("TI", "T1")), abstract=flat(first_of("AB", "N2")), year=year_of(first_of("PY", "Y1", "DA")), document_type=first_of("TY"),
        doi=F.coalesce(doi_of(first_of("DO")), doi_of(first_of("UR"))), issn=first_issn(first_of("SN")), url=F.when(first_of("UR").rlike("(?i)^https?://"), first_of("UR")), language=first_of("LA"),
        source_title=flat(first_of("JO", "T2", "JF", "JA")), volume=first_of("VL"), issue=first_of("IS"), page_start=first_of("SP"), page_end=first_of("EP"), publisher=first_of("PB"),
        author_names=all_of("AU", "A1"), author_keywords=all_of("KW"), affiliations=all_of("AD"),
    )


def read_nbib(spark: SparkSession, path: str) -> DataFrame:
    """MEDLINE: a record begins at PMID, a tag fills four characters, continuation lines join the value with a space."""
    rows = _records(spark, path, "PMID- ", "[A-Z]{2,4} *", "- ", opens="PMID- ")
    rows = rows.where(F.exists("fields", lambda x: (x["tag"] == "TI") | (x["tag"] == "AU")))
    flat = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    doi = lambda tag: F.get(F.filter(all_of(tag), lambda x: x.contains("[doi]")), F.lit(0))
    pages = F.split(first_of("PG"), "-")
    return record(
        rows, source=F.lit("pubmed"), external_id=first_of("PMID"), title=flat(first_of("TI")), abstract=flat(first_of("AB")), year=year_of(first_of("DP")), document_type=first_of("PT"),
        doi=doi_of(F.coalesce(doi("AID"), doi("LID"))), issn=first_issn(first_of("IS")), language=first_of("LA"), source_title=F.coalesce(first_of("JT"), first_of("TA")), volume=first_of("VI"), issue=first_of("IP"),
        page_start=F.get(pages, F.lit(0)), page_end=F.get(pages, F.lit(1)), author_names=F.when(F.size(all_of("FAU")) > 0, all_of("FAU")).otherwise(all_of("AU")),
        author_keywords=F.transform(all_of("OT"), lambda x: F.rtrim(F.regexp_replace(flat(x), r"\*$", ""))), indexed_keywords=F.transform(all_of("MH"), lambda x: F.rtrim(F.regexp_replace(flat(x), r"\*$", ""))), affiliations=F.transform(all_of("AD"), flat),
    )


def read_wos(spark: SparkSession, path: str) -> DataFrame:
    """Tagged text of PT … ER records; lines that begin with spaces continue a tag, a line each for lists."""
    rows = _records(spark, path, "ER", "[A-Z][A-Z0-9]", "(?: |(?=\n)|$)").where(F.exists("fields", lambda x: x["tag"] == "PT"))
    lines = lambda *t: F.flatten(F.transform(all_of(*t), lambda x: F.split(x, r"\s*\n\s*")))
    flat = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    places = F.transform(lines("C1"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\[[^\]]*\]\s*", ""), r"\.$", "")))
    return record(
        rows, source=F.lit("wos"), external_id=first_of("UT"), title=flat(first_of("TI")), abstract=flat(first_of("AB")), year=year_of(first_of("PY")), document_type=flat(first_of("DT")), doi=doi_of(first_of("DI")),
        issn=F.coalesce(first_issn(first_of("SN")), first_issn(first_of("EI"))), language=first_of("LA"), source_title=flat(first_of("SO")), volume=first_of("VL"), issue=first_of("IS"), page_start=first_of("BP"), page_end=first_of("EP"), publisher=first_of("PU"),
        cited_by=first_of("TC", "CT"), open_access_status=first_of("OA"), author_names=F.when(F.size(lines("AF")) > 0, lines("AF")).otherwise(lines("AU")), author_keywords=F.split(flat(first_of("DE")), ";"), indexed_keywords=F.split(flat(first_of("ID")), ";"),
        affiliations=places, references=lines("CR"), countries=F.transform(places, country_of), institutions=F.transform(places, lambda x: F.trim(F.get(F.split(x, ","), F.lit(0)))),
    )


# ---- tables ----


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True)


def _cell(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that the file has."""
    own = {c.strip().lstrip("\ufeff").lower(): c for c in rows.columns}
    return next((F.col(f"`{own[n.lower()]}`") for n in names if n.lower() in own), F.lit(None).cast("string"))


def read_scopus_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    c = lambda *n: _cell(rows, *n)
    places = F.split(c("Affiliations"), ";")
    return record(
        rows, source=F.lit("scopus"), external_id=c("EID"), title=c("Title"), abstract=c("Abstract"), year=year_of(c("Year")), document_type=c("Document Type"), doi=doi_of(c("DOI")), issn=first_issn(c("ISSN")), url=c("Link"),
        language=c("Language of Original Document"), source_title=c("Source title"), volume=c("Volume"), issue=c("Issue"), page_start=c("Page start"), page_end=c("Page end"), publisher=c("Publisher"), cited_by=c("Cited by"), open_access_status=c("Open Access"),
        author_names=F.split(c("Authors"), ";"), author_keywords=F.split(c("Author Keywords"), ";"), indexed_keywords=F.split(c("Index Keywords"), ";"), affiliations=places, references=F.split(c("References"), ";"),
        countries=F.transform(F.transform(places, bare), country_of), institutions=F.transform(F.transform(places, bare), institution_of),
    )


def read_lens_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    c = lambda *n: _cell(rows, *n)
    open_ = F.when(F.lower(c("Is Open Access")) == "true", F.coalesce(F.lower(c("Open Access Colour")), F.lit("open"))).when(F.lower(c("Is Open Access")) == "false", "closed")
    return record(
        rows, source=F.lit("lens"), external_id=c("Lens ID"), title=c("Title"), abstract=c("Abstract"), year=year_of(c("Publication Year")), document_type=c("Publication Type"), doi=doi_of(c("DOI")), issn=first_issn(c("ISSNs")), url=c("External URL"),
        source_title=c("Source Title"), volume=c("Volume"), issue=c("Issue Number"), page_start=c("Start Page"), page_end=c("End Page"), publisher=c("Publisher"), cited_by=c("Citing Works Count"), open_access_status=open_,
        author_names=F.split(c("Author/s"), ";"), author_keywords=F.split(c("Keywords"), ";"), indexed_keywords=F.split(c("MeSH Terms"), ";"), references=F.split(c("References"), ";"),
    )


def read_pubmed_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    c = lambda *n: _cell(rows, *n)
    return record(rows, source=F.lit("pubmed"), external_id=c("PMID"), title=c("Title"), year=year_of(c("Publication Year")), document_type=F.lit("Article"), doi=doi_of(c("DOI")), source_title=c("Journal/Book"), author_names=F.split(F.regexp_replace(c("Authors"), r"\.$", ""), ","))


WORK = "id string, doi string, title string, publication_year int, type string, language string, cited_by_count int, primary_location struct<source:struct<display_name:string,issn_l:string>>, open_access struct<oa_status:string>, authorships array<struct<author:struct<display_name:string>,countries:array<string>,institutions:array<struct<display_name:string>>,raw_affiliation_strings:array<string>>>, keywords array<struct<display_name:string>>, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"


def read_works_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of works, split among tasks; the abstract is rebuilt from its inverted index by position."""
    return _works(spark.read.schema(WORK).json(path))


def read_works_pages(spark: SparkSession, path: str) -> DataFrame:
    """Works as pages with `results` or as arrays, one a file: such a file is one task's, so large ones are better
    exported as lines."""
    rows = spark.read.schema(f"{WORK}, results array<struct<{_nested(WORK)}>>").json(path, multiLine=True)
    own = F.struct(*(c for c in rows.columns if c != "results"))
    return _works(rows.select(F.explode(F.coalesce("results", F.array(own))).alias("w")).select("w.*"))


def _nested(ddl: str) -> str:
    """The fields of a table schema as those of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def _works(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("id").rlike(r"W\d+\s*$"))  # what has no work id is no work
    words = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    words = F.filter(words, lambda x: (x["p"] >= 0) & (x["p"] <= 100_000))
    abstract = F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ")
    a = F.col("authorships")
    each = lambda f: F.flatten(F.transform(a, f))
    return record(
        rows, source=F.lit("openalex"), external_id=F.nullif(F.regexp_extract("id", r"(W\d+)\s*$", 1), F.lit("")), title=F.col("title"), abstract=abstract, year=F.col("publication_year"), document_type=F.col("type"), doi=doi_of(F.col("doi")), issn=first_issn(F.col("primary_location.source.issn_l")),
        language=F.col("language"), source_title=F.col("primary_location.source.display_name"), cited_by=F.col("cited_by_count"), open_access_status=F.col("open_access.oa_status"), author_names=F.transform(a, lambda x: x["author"]["display_name"]),
        author_keywords=F.transform("keywords", lambda x: x["display_name"]), affiliations=each(lambda x: x["raw_affiliation_strings"]), references=F.transform("referenced_works", lambda x: F.nullif(F.regexp_extract(x, r"(W\d+)\s*$", 1), F.lit(""))), countries=each(lambda x: x["countries"]), institutions=each(lambda x: F.transform(x["institutions"], lambda i: i["display_name"])),
    )

