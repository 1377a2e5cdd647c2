"""Files of vocabularies and of classification groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import plain_cell
from marginalia.sources.records import bare

#: The names that the columns of merge tables may have.
HEADERS = ("preferred_name", "preferred_keyword", "preferred_journal", "preferred", "keep_name", "keep", "header")
VARIANTS = ("variant_name", "variant_keyword", "variant_journal", "variant", "discard_name", "discard", "variation")
GROUP_TYPES = ("normal", "validator", "noise", "unclassified")
GROUP_COLUMNS = ("name", "type", "color", "icon", "position", "terms", "match_fields", "start_year", "end_year", "qualis", "nature", "continent", "country_ids", "authors", "use_thesaurus")
MATCH_FIELDS = ("title", "abstract", "author_keywords", "indexed_keywords")


def read_the(spark: SparkSession, path: str) -> DataFrame:
    """header, variations of a thesaurus of ** headers, each followed by its variants, ^…$ or plain."""
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), bare), lambda x: x != "")
    rows = spark.read.option("lineSep", "\n**").text(path).select(F.regexp_replace("value", "\\A\ufeff", "").alias("value"))
    # the record that opens a file still has its **; what comes before the first header has none and is no entry
    first = rows.select(lines.alias("lines"), F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"))
    opening = first.groupBy("file").agg(F.min("at").alias("opening"))
    rows = first.join(opening, "file").where((F.col("at") != F.col("opening")) | F.get("lines", F.lit(0)).startswith("**")).where(F.size("lines") > 0)
    variant = lambda x: bare(F.regexp_replace(F.when(x.contains("^"), F.regexp_replace(x, r"^[^^]*\^", "")).otherwise(x), r"\$$", ""))
    variants = F.array_distinct(F.filter(F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), variant), lambda x: x != ""))
    return rows.select(bare(F.regexp_replace(F.get("lines", F.lit(0)), r"^[*#]+", "")).alias("header"), variants.alias("variations"))


def delimiter(line: str) -> str:
    """The most frequent of ; , and tab outside quotes; a comma if none is more frequent than it."""
    plain = "".join(line.lstrip("\ufeff").split('"')[::2])
    return max((",", ";", "\t"), key=plain.count)


def read_merge_csv(spark: SparkSession, path: str) -> DataFrame:
    """header, variations of a table of preferred and variant names, its delimiter found from the first line."""
    head = spark.read.text(path).where("trim(value) <> ''").first()
    rows = spark.read.csv(path, header=True, sep=delimiter(head[0] if head else ""), quote='"', escape='"', multiLine=True)
    own = {c.strip().lstrip("\ufeff").lower(): c for c in rows.columns}
    cell = lambda names: next((bare(F.col(f"`{own[n]}`")) for n in names if n in own), F.lit(None).cast("string"))
    pairs = rows.select(cell(HEADERS).alias("header"), cell(VARIANTS).alias("variant")).where("header <> '' AND variant <> ''").distinct()
    return pairs.groupBy("header").agg(F.array_sort(F.collect_list("variant")).alias("variations"))


def the_lines(pairs: DataFrame) -> DataFrame:
    """value lines of a thesaurus file for pairs(header, variation), headers in order; write them as text in that order."""
    rows = pairs.select(F.lower(bare(F.col("header"))).alias("header"), F.lower(bare(F.col("variation"))).alias("variation")).where("header <> ''")
    heads = rows.select("header", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("variation")).distinct()
    both = heads.union(rows.where("variation <> ''").select("header", F.lit(1).alias("kind"), "variation"))
    line = F.when(F.col("kind") == 0, F.concat(F.lit("**#"), "header")).otherwise(F.concat(F.lit("100 1 ^"), "variation", F.lit("$")))
    return both.orderBy("header", "kind", "variation").select(line.alias("value"))


def read_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(groups, rules) of a ; table of 15 columns, or of 14 without the stratum. An unknown type becomes normal; of rows
    of one name, but for case, the last one counts."""
    lines = spark.read.csv(path, sep=";", quote='"', escape='"', multiLine=True, header=False)
    wide, names = len(lines.columns) >= 15, list(GROUP_COLUMNS)
    if not wide:
        names.remove("qualis")
    at = F.monotonically_increasing_id()
    cells = [F.coalesce(bare(plain_cell(F.col(c))), F.lit("")).alias(n) for c, n in zip(lines.columns, names, strict=False)]
    rows = lines.select(at.alias("__at"), *cells).where("__at <> 0")  # the header
    for n in GROUP_COLUMNS:
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(""))
    rows = rows.where("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("__at", *GROUP_COLUMNS), "__at").alias("x")).select("key", "x.*")

    def items(c: str | Column, sep: str = ";") -> Column:
        return F.filter(F.transform(F.split(c, sep), bare), lambda x: x != "")

    some = lambda c: F.when(F.size(c) > 0, c)
    year = lambda c: F.when(F.col(c) != "", F.col(c).cast("int"))
    groups = rows.select(
        "key", "name", F.when(F.col("type").isin(*GROUP_TYPES), F.col("type")).otherwise("normal").alias("type"), F.coalesce(F.nullif("color", F.lit("")), F.lit("#4f8ef7")).alias("color"), "icon", F.coalesce(F.try_to_number("position", F.lit("999999")).cast("int"), F.lit(0)).alias("position"),
        F.coalesce(some(items("match_fields")), F.array(*map(F.lit, MATCH_FIELDS))).alias("match_fields"), year("start_year").alias("start_year"), year("end_year").alias("end_year"), some(items(F.upper("qualis"))).alias("qualis"),
        some(items("nature")).alias("nature"), F.nullif("continent", F.lit("")).alias("continent"), some(items("country_ids")).alias("country_ids"), some(items("authors")).alias("authors"), (F.col("use_thesaurus") != "0").alias("use_thesaurus"),
    )
    rules = rows.select("key", F.posexplode(items("terms", "[;,]")).alias("position", "term"))
    return groups, rules
