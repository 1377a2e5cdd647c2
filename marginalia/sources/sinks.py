"""Writers of report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import safe_cell


def safe_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV in which no text cell is a formula to a spreadsheet."""
    df.select(*(safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.csv(path, header=True, sep=sep, quote='"', escape='"')


def years_wide(rows: DataFrame, years: list[int]) -> DataFrame:
    """Keyword evolution, a column a year and the total; the years are given, so the pivot needs no pass of its own."""
    wide = rows.groupBy("keyword", "label").pivot("year", years).agg(F.sum("doc_count"))
    total = sum((F.coalesce(F.col(str(y)), F.lit(0)) for y in years), F.lit(0))
    return wide.na.fill(0).withColumn("total", total)


def matrix_wide(cells: DataFrame, cols: list[str], total: str = "Total") -> DataFrame:
    """A matrix's cells(row, col, weight) as a table: a column for each of cols and the sum, and a last row of sums. cols
    are given, at most as many as the matrix has, so the pivot needs no pass of its own."""
    wide = cells.groupBy("row").pivot("col", cols).agg(F.sum("weight")).na.fill(0)
    name = lambda c: F.col(f"`{c}`")
    wide = wide.withColumn(total, sum((name(c) for c in cols), F.lit(0).cast("long")))
    return wide.unionByName(wide.agg(F.lit(total).alias("row"), *(F.coalesce(F.sum(name(c)), F.lit(0)).alias(c) for c in (*cols, total))))


def joined_classification(assigned: DataFrame, groups: DataFrame) -> DataFrame:
    """A row a document, its groups, types and terms joined by | in the groups' order."""
    g = groups.select(F.col("id").alias("group_id"), "type", "position")
    rows = assigned.join(g, "group_id", "left").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "group_id", "type", "term"))).alias("x"))
    show = lambda f: F.array_join(F.transform("x", lambda x: x[f].cast("string")), "|")
    return rows.select("document_id", show("group_id").alias("groups"), show("type").alias("types"), show("term").alias("terms"))


def category_lines(docs: DataFrame, assigned: DataFrame, fallback: str) -> DataFrame:
    """value lines of a category file: the header, then each document's first group in order of ids, or the fallback."""
    first = assigned.groupBy("document_id").agg(F.min("group_id").alias("g"))
    rows = docs.select(F.col("id").alias("document_id")).join(first, "document_id", "left").orderBy("document_id").select(F.coalesce(F.col("g").cast("string"), F.lit(fallback)).alias("value"))
    head = docs.sparkSession.createDataFrame([("label",)], "value string")
    return head.union(rows)


CITIES = ("city", "state", "state_sigla", "country", "continent", "document_count", "citation_count")


def write_cities(report: DataFrame, path: str) -> None:
    """The cities report as one CSV in its order; a row for each city."""
    rows = report.orderBy(F.desc("doc_count"), "city_id").select("city", "state", "state_sigla", "country", "continent", "doc_count", "citations").toDF(*CITIES)
    safe_csv(rows.na.fill("").coalesce(1), path, ",")


#: The columns of the files of groups, of their comparison, and of author names.
GROUP_HEADER = ("nome", "tipo", "cor", "icone", "posicao", "termos", "campos_match", "ano_inicio", "ano_fim", "qualis", "natureza_instituicao", "continente", "paises", "autores", "usar_tesauro")
COMPARISON_HEADER = ("ID Grupo", "Nome do Grupo", "Tipo", "Total Documentos", "% do Corpus", "Total Citações", "Média Citações")
NAMES_HEADER = ("preferred_name", "variant_name", "source", "created_at")


def group_rows(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a group under GROUP_HEADER, as read_groups reads it; lists are joined by "; ", a group's terms in their order."""
    terms = rules.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]), "; ").alias("terms"))
    listed = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = groups.join(terms, "key", "left").orderBy("position", "name")
    cells = [*map(plain, ("name", "type", "color", "icon", "position", "terms")), listed("match_fields"), *map(plain, ("start_year", "end_year")), listed("qualis"), listed("nature"), plain("continent"), listed("country_ids"), listed("authors")]
    return rows.select(*cells, F.when(F.col("use_thesaurus"), "1").otherwise("0")).toDF(*GROUP_HEADER)


def comparison_rows(stats: DataFrame, groups: DataFrame, documents: int) -> DataFrame:
    """A row a group of stats(group_id, doc_count, citations) under COMPARISON_HEADER; groups(id, name, type)."""
    share = F.format_string("%.1f", F.when(F.lit(documents) > 0, 100.0 * F.col("doc_count") / F.lit(documents)).otherwise(0.0))
    mean = F.format_string("%.2f", F.col("citations") / F.col("doc_count"))
    rows = stats.join(groups.select(F.col("id").alias("group_id"), "name", "type"), "group_id").orderBy("group_id")
    return rows.select("group_id", "name", "type", "doc_count", share, "citations", mean).toDF(*COMPARISON_HEADER)


def name_rows(authors: DataFrame, variants: DataFrame, links: DataFrame) -> DataFrame:
    """The written forms that differ from the preferred name, of authors(id, name) with links(author_id);
    variants(author_id, original_name, source, created_at)."""
    rows = variants.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id").join(links.select("author_id").distinct(), "author_id", "left_semi")
    return rows.where("original_name <> name").select("name", "original_name", "source", "created_at").distinct().toDF(*NAMES_HEADER).orderBy(*NAMES_HEADER[:2])
