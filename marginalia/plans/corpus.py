"""The bibliographic corpus as DataFrames, and its binding to the star-schema test tables.

VIEWS are the raw corpus tables as SQL that Spark and DuckDB read alike; {name} stands for a source table or an earlier
view. Derived tables (effective identities) are operators, not views.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.identity import effective_authors, effective_keywords, keyword_labels
from marginalia.sources.store import store_folder
from marginalia.sources.versions import ResultCache, file_system, snapshot_id

PROJECT = 2
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS: dict[str, str] = {
    "project": """SELECT 1 AS id, 1 AS owner_id, 'AUTOMOBILE' AS title UNION ALL SELECT 2, 0, 'BUILDING' UNION ALL SELECT 3, 1, 'FURNITURE'
        UNION ALL SELECT 4, 0, 'HOUSEHOLD' UNION ALL SELECT 5, 1, 'MACHINERY'""",
    "document": """SELECT * FROM (
        SELECT o_orderkey AS id,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS project_id,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS INT) END AS cited_by,
          CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN NULL ELSE concat('Source ', CAST(CAST(floor(sqrt(o_custkey)) AS INT) AS STRING)) END AS source_title,
          CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE concat('1000-', CAST(CAST(1000 + floor(sqrt(o_custkey)) AS INT) AS STRING)) END AS issn,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A1' WHEN '2' THEN 'A2' WHEN '3' THEN 'B1' WHEN '5' THEN 'C' END AS qualis,
          o_orderstatus AS document_type,
          CASE o_orderkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'green' WHEN 2 THEN 'closed' END AS open_access_status,
          CASE o_orderkey % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Portuguese' END AS language,
          CASE WHEN o_orderkey % 5 = 0 THEN concat(' 10.1/D', CAST(o_orderkey % 400 AS STRING), ' ') END AS doi
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
      ) d WHERE NOT (project_id = 3 AND year = 1997)""",
    "document_author": "SELECT l_orderkey AS document_id, l_suppkey AS author_id, l_linenumber AS position FROM {lineitem}",
    "author": "SELECT s_suppkey AS id, s_name AS preferred_name FROM {supplier}",
    "authority_mapping": """SELECT 'author' AS entity_type, 'global' AS scope, 0 AS scope_id, s_suppkey AS source_id, s_suppkey - 9 AS target_id FROM {supplier} WHERE s_suppkey % 10 = 9
        UNION ALL SELECT 'author', 'user', 0, s_suppkey, s_suppkey - 5 FROM {supplier} WHERE s_suppkey % 30 = 5
        UNION ALL SELECT 'author', 'project', 2, s_suppkey, s_suppkey - 3 FROM {supplier} WHERE s_suppkey % 20 = 13 OR s_suppkey % 40 = 9
        UNION ALL SELECT 'keyword', 'project', 2, p_partkey, p_partkey - 1 FROM {part} WHERE p_partkey % 50 = 1""",
    "keyword": """SELECT p_partkey AS id, p_name AS display, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS original, p_name AS normalized,
        CASE p_size % 2 WHEN 0 THEN 'author_keyword' ELSE 'indexed_keyword' END AS type,
        min(p_partkey) OVER (PARTITION BY p_name, p_size % 2) AS keyword_concept_id,
        CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN min(p_partkey) OVER (PARTITION BY p_name) + 1 END AS thesaurus_concept_id
      FROM {part}""",
    "concept": """SELECT min(p_partkey) + 1 AS id, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS label FROM {part} GROUP BY p_name""",
    "document_keyword": "SELECT l_orderkey AS document_id, l_partkey AS keyword_id FROM {lineitem}",
    "document_keyword_position": "SELECT l_orderkey AS document_id, l_partkey AS keyword_id, l_linenumber AS position FROM {lineitem}",
    "document_country": """SELECT DISTINCT l_orderkey AS document_id, n_nationkey AS country_id, n_name AS country, r_name AS continent
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "institution": """SELECT DISTINCT s_suppkey % 50 AS id, concat('Institution ', CAST(s_suppkey % 50 AS STRING)) AS official_name,
        CASE (s_suppkey % 50) % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' END AS nature, (s_suppkey % 50) % 25 AS country_id FROM {supplier}""",
    "city": """SELECT DISTINCT s_suppkey % 30 AS id, concat('City ', CAST(s_suppkey % 30 AS STRING)) AS name, CASE WHEN (s_suppkey % 30) % 3 > 0 THEN (s_suppkey % 30) % 7 END AS state_id, (s_suppkey % 30) % 25 AS country_id FROM {supplier}""",
    "state": """SELECT DISTINCT s_suppkey % 7 AS id, concat('State ', CAST(s_suppkey % 7 AS STRING)) AS name, concat('S', CAST(s_suppkey % 7 AS STRING)) AS sigla FROM {supplier}""",
    "country": "SELECT n_nationkey AS id, n_name AS name, r_name AS continent FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "document_city": "SELECT l_orderkey AS document_id, l_suppkey % 30 AS city_id FROM {lineitem}",
    "document_institution": "SELECT l_orderkey AS document_id, l_suppkey % 50 AS institution_id FROM {lineitem}",
}
#: For the oracles only: the same effective identities in SQL.
ORACLE_VIEWS: dict[str, str] = {
    "eff_author": """SELECT l.document_id, l.author_id, l.position, coalesce(p.target_id, u.target_id, g.target_id, l.author_id) AS author
      FROM {document_author} l JOIN {document} d ON d.id = l.document_id JOIN {project} j ON j.id = d.project_id
      LEFT JOIN {authority_mapping} p ON p.entity_type = 'author' AND p.scope = 'project' AND p.scope_id = d.project_id AND p.source_id = l.author_id
      LEFT JOIN {authority_mapping} u ON u.entity_type = 'author' AND u.scope = 'user' AND u.scope_id = j.owner_id AND u.source_id = l.author_id
      LEFT JOIN {authority_mapping} g ON g.entity_type = 'author' AND g.scope = 'global' AND g.source_id = l.author_id""",
    "eff_keyword": """SELECT l.document_id, l.keyword_id, k.type, coalesce(p.target_id, CASE WHEN k.thesaurus_concept_id IS NULL THEN coalesce(k.keyword_concept_id, k.id) ELSE -k.thesaurus_concept_id END) AS keyword
      FROM {document_keyword} l JOIN {document} d ON d.id = l.document_id JOIN {keyword} k ON k.id = l.keyword_id
      LEFT JOIN {authority_mapping} p ON p.entity_type = 'keyword' AND p.scope = 'project' AND p.scope_id = d.project_id AND p.source_id = l.keyword_id""",
    "kw_label": """SELECT -id AS keyword, label FROM {concept} UNION ALL SELECT id, coalesce(display, original) FROM {keyword}""",
    "doc": "SELECT * FROM {document} WHERE project_id = 2",
    "da": "SELECT DISTINCT e.document_id, e.author FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id",
    "dk": "SELECT DISTINCT e.document_id, e.keyword, e.type FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id",
    "dc": "SELECT c.* FROM {document_country} c JOIN {doc} d ON d.id = c.document_id",
    "title": "SELECT l_orderkey AS document_id, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name) AS title FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY 1",
}


def oracle(sql: str) -> str:
    """DuckDB SQL for a query over {view} names: the views it needs as common table expressions, in order."""
    defs, order, seen = VIEWS | ORACLE_VIEWS, [], set()

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in defs and name not in seen:
                seen.add(name)
                need(defs[name])
                order.append(name)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS ({plain(defs[n])})" for n in order)
    body = plain(sql).strip()
    start = next((w for w in ("WITH RECURSIVE", "WITH") if body.startswith(w)), "")
    return f"{start or 'WITH'} {head}{',' if start else ' '}{body[len(start):]}" if head else body


#: Views that every query would otherwise derive anew.
STORED = ("document", "keyword", "concept", "document_country", "institution")


class Corpus:
    """One project's corpus; every attribute is a DataFrame.

    What many queries need (documents, effective identities of links, labels, titles, assignments) is derived once and
    kept as Parquet tables, as an import would leave it. The tables lie in the folder that the session names in
    spark.checkpoint.dir; where a session on one machine names none, in a folder of its own; else nothing is kept.

    All of it belongs to one version of the input files (snapshot_id). of() gives a new corpus when the version has moved;
    kept tables of the version before stay for those who still read them, older ones are deleted.
    """

    _opened: dict[tuple, Corpus] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, project_id: int = PROJECT):
        self.spark, self.sf_dir, self.project_id, self._views, self._kept, self._tables, self._files = spark, sf_dir, project_id, {}, {}, {}, {}
        self.version, self._before, self.seconds = self.current_version(), None, 0.0

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, project_id: int = PROJECT) -> Corpus:
        """The corpus that this application has opened before over the same files, or a new one."""
        key = (spark.sparkContext.applicationId, sf_dir, project_id)
        old = cls._opened.get(key)
        if old is None or old.version is None or old.version != old.current_version():
            new = cls(spark, sf_dir, project_id)
            if old is not None:
                if old._before is not None:
                    old._before.drop()
                new._before, old._before = old, None
            cls._opened = {k: c for k, c in cls._opened.items() if k[0] == key[0]} | {key: new}
        return cls._opened[key]

    @classmethod
    def answer(cls, spark: SparkSession, sf_dir: str, make: Callable[[Corpus], DataFrame], project_id: int = PROJECT) -> DataFrame:
        """make(corpus); once more if the input's version moves while it is made, as it may mix two states of the data."""
        for _ in range(3):
            corpus = cls.of(spark, sf_dir, project_id)
            out = make(corpus)
            if corpus.version is not None and corpus.version == corpus.current_version():
                return out
        return make(cls(spark, sf_dir, project_id))  # it moves all the time: nothing of it is kept for others

    def current_version(self) -> str | None:
        return snapshot_id(self.spark, [f"{self.sf_dir}/{name}.parquet" for name in SOURCES])

    def drop(self) -> None:
        """Delete the kept tables and files."""
        for at in [*self._tables.values(), *self._files.values()]:
            fs, path = file_system(self.spark, at)
            fs.delete(path, True)
        self._kept, self._tables, self._files = {}, {}, {}

    @property
    def results(self) -> ResultCache:
        """Results of this project's analyses, kept by version for all sessions with the same shared folder."""
        return ResultCache(self.spark, self.current_version)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made and written at the first call."""
        if name not in self._kept:
            df = make()
            if folder := store_folder(self.spark):
                began, at = time.time(), f"{folder}/corpus-{name}-{uuid.uuid4().hex}"
                df.write.parquet(at)
                self.seconds += time.time() - began
                self._tables[name], df = at, self.spark.read.schema(df.schema).parquet(at)
            self._kept[name] = df
        return self._kept[name]

    def exported(self, name: str, write: Callable[[str], None]) -> str:
        """The path of an export file of the corpus, written at the first call; see the class for where."""
        if name not in self._files:
            if not (folder := store_folder(self.spark)):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            self._files[name] = f"{folder}/export-{name}-{uuid.uuid4().hex}"
            write(self._files[name])
        return self._files[name]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self.source(name)
        if name not in self._views:
            sql = VIEWS[name]
            make = lambda: self.spark.sql(sql, **{n: self.view(n) for n in set(re.findall(r"\{(\w+)\}", sql))})
            self._views[name] = self.kept(name, make) if name in STORED else make()
        return self._views[name]

    @property
    def documents(self) -> DataFrame:
        return self.kept("documents", lambda: self.view("document").where(f"project_id = {self.project_id}"))

    @property
    def author_links(self) -> DataFrame:
        """document_id, author_id, position and the effective author of each link of the project."""
        return self.kept("author_links", lambda: effective_authors(self.view("document_author"), self.documents, self.view("project"), self.view("authority_mapping")))

    @property
    def keyword_links(self) -> DataFrame:
        return self.kept("keyword_links", lambda: effective_keywords(self.view("document_keyword"), self.documents, self.view("project"), self.view("authority_mapping"), self.view("keyword")))

    @property
    def document_authors(self) -> DataFrame:
        """Distinct (document_id, author): every count and sum is over these."""
        return self.kept("document_authors", lambda: self.author_links.select("document_id", "author").distinct())

    @property
    def document_keywords(self) -> DataFrame:
        return self.kept("document_keywords", lambda: self.keyword_links.select("document_id", "keyword", "type").distinct())

    @property
    def words(self) -> DataFrame:
        """Distinct (document_id, keyword), of any type."""
        return self.kept("words", lambda: self.document_keywords.select("document_id", "keyword").distinct())

    @property
    def labels(self) -> DataFrame:
        return self.kept("labels", lambda: keyword_labels(self.view("keyword"), self.view("concept")))

    def of_project(self, view: str) -> DataFrame:
        return self.view(view).join(self.documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")

    @property
    def document_countries(self) -> DataFrame:
        return self.kept("document_countries", lambda: self.of_project("document_country"))

    @property
    def document_institutions(self) -> DataFrame:
        return self.kept("document_institutions", lambda: self.of_project("document_institution").distinct())

    @property
    def titles(self) -> DataFrame:
        """document_id, title: the names of an order's parts."""
        def make() -> DataFrame:
            named = self.of_project("document_keyword_position").join(self.view("keyword").select(F.col("id").alias("keyword_id"), "display"), "keyword_id")
            words = F.transform(F.array_sort(F.collect_list(F.struct("position", "display"))), lambda x: x["display"])
            return named.groupBy("document_id").agg(F.array_join(words, " ").alias("title"))

        return self.kept("titles", make)
