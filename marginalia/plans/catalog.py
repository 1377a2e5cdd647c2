"""Registered queries over the test tables and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import classify as C
from marginalia.operators import importing as M
from marginalia.operators import indicators as I
from marginalia.operators import networks as N
from marginalia.operators import enrichment as E
from marginalia.operators import identity as D
from marginalia.operators import similarity as S
from marginalia.operators import treatment as T
from marginalia.plans.corpus import Corpus, oracle
from marginalia.sources import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The configuration of the classification queries.
GROUPS = [(1, "validator", 0), (2, "noise", 1), (3, "normal", 2), (4, "normal", 3), (5, "normal", 4), (6, "normal", 5)]
RULES = [(1, 0, "bolt"), (1, 1, "gear"), (1, 2, "ring"), (2, 0, "old anvil"), (3, 0, "red"), (3, 1, "blue"), (4, 0, "small"), (5, 0, "large plate"), (5, 1, "hot gear"), (6, 0, "widget")]
LENSES = [("colour", "red"), ("colour", "blue"), ("size", "small"), ("joint", "ring red"), ("part", "ring")]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Corpus], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: Corpus.answer(spark, sf_dir, f)
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def groups(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame(GROUPS, "id int, type string, position int")


def rules(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame(RULES, "group_id int, position int, term string")


def texts(c: Corpus) -> DataFrame:
    """document_id, year, text."""
    return c.kept("texts", lambda: c.documents.select(F.col("id").alias("document_id"), "year").join(c.titles, "document_id").withColumnRenamed("title", "text"))


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(map(str, rows))}) t({names})"


# ---- production and citations ----

PER_YEAR = """p AS (SELECT year, count(*) AS n, sum(coalesce(cited_by, 0)) AS c FROM {doc} WHERE year IS NOT NULL GROUP BY year),
 y AS (SELECT unnest(generate_series((SELECT min(year) FROM p), (SELECT max(year) FROM p))) AS year),
 g AS (SELECT CAST(y.year AS INT) AS year, CAST(coalesce(n, 0) AS BIGINT) AS doc_count, CAST(coalesce(c, 0) AS BIGINT) AS citations FROM y LEFT JOIN p ON p.year = y.year)"""


@query("WITH " + PER_YEAR + " SELECT * FROM g")
def annual_production(c):
    return I.annual_production(c.documents)


@query("WITH " + PER_YEAR + """ SELECT year, doc_count, citations, CASE WHEN doc_count > 0 THEN round(citations / doc_count, 1) ELSE 0.0 END AS avg_citations,
 CAST(sum(doc_count) OVER (ORDER BY year) AS BIGINT) AS cumulative,
 CASE WHEN lag(doc_count) OVER (ORDER BY year) > 0 THEN round((doc_count - lag(doc_count) OVER (ORDER BY year)) / lag(doc_count) OVER (ORDER BY year) * 100, 1) END AS growth,
 CASE WHEN row_number() OVER (ORDER BY year) >= 3 THEN round(avg(doc_count) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 1) END AS moving_avg FROM g""")
def annual_detail(c):
    return I.annual_detail(c.documents)


@query("WITH " + PER_YEAR + """, k AS (SELECT count(*) AS years, CAST(sum(doc_count) AS BIGINT) AS documents, round(avg(doc_count), 1) AS avg_per_year FROM g),
 b AS (SELECT year AS best_year FROM g ORDER BY doc_count DESC, year LIMIT 1), f AS (SELECT doc_count AS a FROM g ORDER BY year LIMIT 1), l AS (SELECT doc_count AS z FROM g ORDER BY year DESC LIMIT 1)
 SELECT years, documents, avg_per_year, best_year, CASE WHEN years > 1 AND a > 0 THEN round((pow(z / a, 1 / (years - 1)) - 1) * 100, 1) END AS cagr FROM k, b, f, l""")
def annual_kpis(c):
    return I.annual_kpis(c.documents)


@query("WITH " + PER_YEAR + """ SELECT year, doc_count, CASE WHEN lag(doc_count) OVER (ORDER BY year) > 0 THEN
 round((doc_count - lag(doc_count) OVER (ORDER BY year)) / lag(doc_count) OVER (ORDER BY year) * 100, 1) END AS growth FROM g""")
def growth_rate(c):
    return I.growth_rate(c.documents)


@query("""WITH p AS (SELECT year, sum(cited_by) AS s, avg(cited_by) AS a, max(cited_by) AS m, count(*) AS n FROM {doc} WHERE year IS NOT NULL AND cited_by IS NOT NULL GROUP BY year),
 y AS (SELECT unnest(generate_series((SELECT min(year) FROM p), (SELECT max(year) FROM p))) AS year)
 SELECT CAST(y.year AS INT) AS year, CAST(coalesce(s, 0) AS BIGINT) AS citations, coalesce(round(a, 2), 0.0) AS avg_citations, CAST(coalesce(m, 0) AS INT) AS max_citations, CAST(coalesce(n, 0) AS BIGINT) AS documents FROM y LEFT JOIN p ON p.year = y.year""")
def citations_per_year(c):
    return I.citations_per_year(c.documents)


@query("""WITH r AS (SELECT cited_by, row_number() OVER (ORDER BY cited_by DESC) AS rn FROM {doc} WHERE cited_by IS NOT NULL)
 SELECT CAST(coalesce(max(CASE WHEN cited_by >= rn THEN rn END), 0) AS BIGINT) AS h_index FROM r""")
def h_index(c):
    return I.h_index(c.documents)


@query("""SELECT count(*) AS documents, CAST(coalesce(sum(cited_by), 0) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 2) AS avg_citations,
 count(DISTINCT CASE WHEN source_title <> '' THEN source_title END) AS sources, min(year) AS first_year, max(year) AS last_year,
 count(CASE WHEN open_access_status NOT IN ('closed', '') THEN 1 END) AS open_access,
 (SELECT count(DISTINCT author) FROM {da}) AS authors, (SELECT count(DISTINCT keyword) FROM {dk}) AS keywords FROM {doc}""")
def summary(c):
    return I.summary(c.documents, c.document_authors, c.document_keywords)


def _dist(column: str) -> str:
    return f"SELECT coalesce({column}, 'Unknown') AS label, count(*) AS doc_count FROM {{doc}} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


@query(_dist("document_type"))
def dist_type(c):
    return I.distribution(c.documents, "document_type")


@query(_dist("open_access_status"))
def dist_oa(c):
    return I.distribution(c.documents, "open_access_status")


@query(_dist("language"))
def dist_lang(c):
    return I.distribution(c.documents, "language")


@query("""SELECT source_title, count(*) AS doc_count, CAST(sum(cited_by) AS BIGINT) AS citations, round(avg(cited_by), 1) AS avg_citations FROM {doc}
 WHERE source_title <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_sources(c):
    return I.top_sources(c.documents)


@query("""SELECT source_title, max(issn) AS issn, min(qualis) AS best_stratum, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations FROM {doc}
 WHERE source_title <> '' GROUP BY 1 ORDER BY 4 DESC, 5 DESC, 1 LIMIT 100""")
def sources_report(c):
    return I.sources_report(c.documents)


@query("""WITH s AS (SELECT source_title, count(*) AS n, sum(coalesce(cited_by, 0)) AS c FROM {doc} WHERE source_title <> '' GROUP BY 1),
 r AS (SELECT *, row_number() OVER w AS rn, sum(n) OVER (ORDER BY n DESC, c DESC, source_title ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM s WINDOW w AS (ORDER BY n DESC, c DESC, source_title))
 SELECT source_title, n AS doc_count, CAST(c AS BIGINT) AS citations, CAST(cum AS BIGINT) AS cumulative, CASE WHEN rn = 1 OR cum <= round(total * 0.33) THEN 1 WHEN cum <= round(total * 0.67) THEN 2 ELSE 3 END AS zone FROM r""")
def bradford(c):
    return I.bradford(c.documents)


@query("""SELECT coalesce(qualis, 'none') AS stratum, count(*) AS doc_count, CAST(CASE coalesce(qualis, 'none') WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 5 WHEN 'C' THEN 10 ELSE 99 END AS INT) AS position FROM {doc} GROUP BY 1""")
def qualis_dist(c):
    return I.qualis_distribution(c.documents)


# ---- authors ----


@query("""SELECT author, preferred_name AS name, doc_count, citations FROM (SELECT author, count(*) AS doc_count, CAST(sum(cited_by) AS BIGINT) AS citations FROM {da} JOIN {doc} d ON d.id = document_id
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t JOIN {author} a ON a.id = t.author""")
def top_authors(c):
    return I.top_authors(c.document_authors, c.documents, c.view("author"))


HG = """x AS (SELECT author, coalesce(cited_by, 0) AS cited, row_number() OVER w AS rn, sum(coalesce(cited_by, 0)) OVER (PARTITION BY author ORDER BY coalesce(cited_by, 0) DESC, document_id ROWS UNBOUNDED PRECEDING) AS total
 FROM {da} JOIN {doc} d ON d.id = document_id WINDOW w AS (PARTITION BY author ORDER BY coalesce(cited_by, 0) DESC, document_id)),
 hg AS (SELECT author, CAST(coalesce(max(CASE WHEN cited >= rn THEN rn END), 0) AS BIGINT) AS h_index, CAST(coalesce(max(CASE WHEN total >= rn * rn THEN rn END), 0) AS BIGINT) AS g_index FROM x GROUP BY 1)"""


@query("WITH " + HG + """, t AS (SELECT author, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 1) AS avg_citations, min(year) AS first_year, max(year) AS last_year
 FROM {da} JOIN {doc} d ON d.id = document_id GROUP BY 1)
 SELECT author, doc_count, citations, avg_citations, first_year, last_year, preferred_name AS name, h_index, g_index FROM t JOIN hg USING (author) JOIN {author} a ON a.id = author ORDER BY doc_count DESC, citations DESC, author LIMIT 100""")
def authors_report(c):
    return I.authors_report(c.document_authors, c.documents, c.view("author"))


@query("WITH " + HG + " SELECT author, h_index FROM hg")
def author_h(c):
    return I.author_indices(c.document_authors, c.documents).select("author", "h_index")


@query("WITH " + HG + " SELECT author, g_index FROM hg")
def author_g(c):
    return I.author_indices(c.document_authors, c.documents).select("author", "g_index")


@query("""WITH n AS (SELECT n_docs, count(*) AS authors FROM (SELECT author, count(*) AS n_docs FROM {da} GROUP BY 1) GROUP BY 1)
 SELECT n_docs, authors, round(coalesce((SELECT authors FROM n WHERE n_docs = 1), 0) / (n_docs * n_docs), 1) AS expected FROM n""")
def lotka(c):
    return I.lotka(c.document_authors)


@query("""WITH p AS (SELECT document_id, count(*) AS n FROM {da} GROUP BY 1)
 SELECT year, round(avg(n), 2) AS collaboration_index, count(*) AS documents FROM p JOIN {doc} d ON d.id = document_id WHERE year IS NOT NULL GROUP BY 1""")
def collaboration_index(c):
    return I.collaboration_index(c.document_authors, c.documents)


@query("""WITH f AS (SELECT e.document_id, author, min(position) AS position FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id GROUP BY 1, 2)
 SELECT document_id, string_agg(preferred_name, '; ' ORDER BY position, author) AS authors FROM f JOIN {author} a ON a.id = author GROUP BY 1""")
def author_string(c):
    return I.author_string(c.author_links, c.view("author"))


@query("""WITH top AS (SELECT id AS document_id, year, source_title, coalesce(cited_by, 0) AS cited FROM {doc} ORDER BY cited DESC, id LIMIT 100),
 f AS (SELECT e.document_id, author, min(position) AS position FROM {eff_author} e JOIN top USING (document_id) GROUP BY 1, 2),
 n AS (SELECT document_id, string_agg(preferred_name, '; ' ORDER BY position, author) AS authors FROM f JOIN {author} a ON a.id = author GROUP BY 1),
 s AS (SELECT document_id, string_agg(DISTINCT country, ', ' ORDER BY country) AS countries FROM {dc} GROUP BY 1)
 SELECT top.*, authors, countries FROM top LEFT JOIN n USING (document_id) LEFT JOIN s USING (document_id)""")
def documents_report(c):
    return I.documents_report(c.documents, c.author_links, c.view("author"), c.document_countries)


@query("SELECT e.document_id, e.author_id, e.position, e.author FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id")
def effective_author(c):
    return c.author_links


@query("SELECT e.document_id, e.keyword_id, e.type, e.keyword FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id")
def effective_keyword(c):
    return c.keyword_links


@query("SELECT author_id AS author, count(DISTINCT document_id) AS doc_count FROM {document_author} GROUP BY 1")
def link_counts(c):
    return c.view("document_author").groupBy(F.col("author_id").alias("author")).agg(F.countDistinct("document_id").alias("doc_count"))


@query("""SELECT e.author AS target, count(DISTINCT e.document_id) AS doc_count FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id WHERE e.author <> e.author_id GROUP BY 1""")
def groupings_in_use(c):
    return c.author_links.where("author <> author_id").groupBy(F.col("author").alias("target")).agg(F.countDistinct("document_id").alias("doc_count"))


# ---- keywords ----


@query("""WITH r AS (SELECT e.keyword, e.document_id, coalesce(t.label, h.display, k.display) AS label FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id JOIN {keyword} k ON k.id = e.keyword_id
 LEFT JOIN {keyword} h ON h.id = k.keyword_concept_id LEFT JOIN {concept} t ON t.id = k.thesaurus_concept_id WHERE e.type = 'author_keyword')
 SELECT keyword, max(label) AS label, count(DISTINCT document_id) AS doc_count FROM r GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 50""")
def top_keywords(c):
    return I.top_keywords(c.keyword_links, c.view("keyword"), c.view("concept"))


KEYWORDS = """WITH r AS (SELECT e.keyword, l.label, e.document_id, e.type, d.year, k.original FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id JOIN {kw_label} l ON l.keyword = e.keyword JOIN {keyword} k ON k.id = e.keyword_id),
 t AS (SELECT keyword, label, count(DISTINCT document_id) AS freq, count(DISTINCT CASE WHEN type = 'author_keyword' THEN document_id END) AS author_freq, count(DISTINCT CASE WHEN type = 'indexed_keyword' THEN document_id END) AS indexed_freq,
 min(year) AS first_year, max(year) AS last_year, max(contains(lower(original), 'red')) AS hit FROM r GROUP BY 1, 2)
 SELECT keyword, label, freq, author_freq, indexed_freq, first_year, last_year, CASE WHEN author_freq > 0 AND indexed_freq > 0 THEN 'both' WHEN author_freq > 0 THEN 'author' WHEN indexed_freq > 0 THEN 'indexed' ELSE 'raw' END AS kind FROM t"""


@query(KEYWORDS + " ORDER BY freq DESC, label, keyword LIMIT 150")
def keywords_report(c):
    return I.keywords_report(c.keyword_links, c.documents, c.view("keyword"), c.view("concept"))


@query(KEYWORDS + " WHERE contains(lower(label), 'red') OR hit ORDER BY freq DESC, label, keyword LIMIT 300")
def keyword_search(c):
    return I.keywords_report(c.keyword_links, c.documents, c.view("keyword"), c.view("concept"), search="red")


@query("""WITH top AS (SELECT keyword FROM (SELECT DISTINCT document_id, keyword FROM {dk}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
 y AS (SELECT unnest(generate_series(1996, 2000)) AS year), n AS (SELECT keyword, year, count(DISTINCT document_id) AS n FROM {dk} JOIN {doc} d ON d.id = document_id GROUP BY 1, 2)
 SELECT t.keyword, l.label, CAST(y.year AS INT) AS year, coalesce(n, 0) AS doc_count FROM top t JOIN {kw_label} l ON l.keyword = t.keyword CROSS JOIN y LEFT JOIN n ON n.keyword = t.keyword AND n.year = y.year""")
def keyword_evolution(c):
    return I.keyword_evolution(c.document_keywords, c.documents, c.labels, N.top_nodes(c.words, "keyword", 10), 1996, 2000)


@query("""WITH u AS (SELECT e.* FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id WHERE e.keyword < 0), v AS (SELECT keyword, count(DISTINCT keyword_id) AS variant_count FROM u GROUP BY 1),
 p AS (SELECT keyword, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations FROM (SELECT DISTINCT document_id, keyword FROM u) JOIN {doc} d ON d.id = document_id GROUP BY 1)
 SELECT keyword, doc_count, citations, variant_count, c.label, upper(substr(c.label, 1, 1)) AS letter FROM p JOIN v USING (keyword) JOIN {concept} c ON c.id = -keyword""")
def glossary(c):
    return I.glossary(c.keyword_links, c.documents, c.view("concept"))


@query("""SELECT k.id AS keyword_id, k.display, k.type, count(DISTINCT l.document_id) AS doc_count FROM {document_keyword} l JOIN {doc} d ON d.id = l.document_id JOIN {keyword} k ON k.id = l.keyword_id
 WHERE contains(lower(k.display), 'bolt') GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 LIMIT 500""")
def all_keywords(c):
    hit = c.view("keyword").where(F.lower("display").contains("bolt")).select(F.col("id").alias("keyword_id"), "display", "type")
    return c.of_project("document_keyword").join(hit, "keyword_id").groupBy("keyword_id", "display", "type").agg(F.countDistinct("document_id").alias("doc_count")).orderBy(F.desc("doc_count"), "keyword_id").limit(500)


@query("""SELECT a.normalized AS label, min(a.id) AS author_keyword_id, min(b.id) AS indexed_keyword_id FROM {keyword} a JOIN {keyword} b ON lower(trim(a.display)) = lower(trim(b.display)) AND a.type = 'author_keyword' AND b.type = 'indexed_keyword' GROUP BY 1""")
def cross_type(c):
    return S.cross_type(c.view("keyword"))


@query("""SELECT k.id, k.display, c.id AS concept_id FROM {keyword} k LEFT JOIN (SELECT lower(label) AS l, min(id) AS id FROM {concept} GROUP BY 1) c ON c.l = k.normalized""")
def concept_link(c):
    concepts = c.view("concept").groupBy(F.lower("label").alias("normalized")).agg(F.min("id").alias("concept_id"))
    return c.view("keyword").join(concepts, "normalized", "left").select("id", "display", "concept_id")


@query("""WITH r AS (SELECT id, normalized, type, (row_number() OVER (ORDER BY id) - 1) // 500 AS batch FROM {keyword})
 SELECT batch, normalized, type, count(*) AS n, min(id) AS canonical FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def kw_exact_groups(c):
    return S.exact_groups(c.view("keyword"))


# ---- places and institutions ----


def _entity(source: str, key: str) -> str:
    return f"""WITH p AS (SELECT DISTINCT document_id, {key} FROM {{{source}}} WHERE {key} IS NOT NULL)
 SELECT {key}, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 1) AS avg_citations FROM p JOIN {{doc}} d ON d.id = document_id GROUP BY 1"""


@query(_entity("dc", "country"))
def countries_report(c):
    return I.entity_report(c.document_countries, c.documents, "country")


@query(_entity("dc", "continent"))
def geo_continents(c):
    return I.entity_report(c.document_countries, c.documents, "continent")


@query("SELECT continent, count(DISTINCT document_id) AS doc_count FROM {dc} GROUP BY 1")
def continents(c):
    return c.document_countries.groupBy("continent").agg(F.countDistinct("document_id").alias("doc_count"))


@query("SELECT count(DISTINCT document_id) AS mapped, (SELECT count(*) FROM {doc}) AS documents FROM {dc}")
def geo_mapped(c):
    return c.document_countries.agg(F.countDistinct("document_id").alias("mapped")).crossJoin(c.documents.agg(F.count("*").alias("documents")))


INSTITUTIONS = "i AS (SELECT DISTINCT l.document_id, n.official_name, n.nature FROM {document_institution} l JOIN {doc} d ON d.id = l.document_id JOIN {institution} n ON n.id = l.institution_id)"


@query("WITH " + INSTITUTIONS + """ SELECT official_name, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 1) AS avg_citations FROM i JOIN {doc} d ON d.id = document_id GROUP BY 1""")
def institutions_report(c):
    return I.entity_report(_institutions(c), c.documents, "official_name")


@query("WITH " + INSTITUTIONS + """, p AS (SELECT DISTINCT document_id, nature FROM i WHERE nature IS NOT NULL) SELECT nature, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 1) AS avg_citations FROM p JOIN {doc} d ON d.id = document_id GROUP BY 1""")
def geo_nature(c):
    return I.entity_report(_institutions(c), c.documents, "nature")


def _institutions(c: Corpus) -> DataFrame:
    return c.document_institutions.join(c.view("institution").withColumnRenamed("id", "institution_id"), "institution_id")


# ---- networks ----

NODES = "n AS (SELECT {0}, count(*) AS doc_count FROM {1} GROUP BY 1 HAVING count(*) >= {3} ORDER BY 2 DESC, 1 LIMIT {2})"
EDGES = "e AS (SELECT a.{0} AS source, b.{0} AS target, count(*) AS weight FROM {1} a JOIN {1} b ON a.document_id = b.document_id AND a.{0} < b.{0} WHERE a.{0} IN (SELECT {0} FROM n) AND b.{0} IN (SELECT {0} FROM n) GROUP BY 1, 2)"
CO = "WITH " + NODES.format("author", "{{da}}", 100, 1).replace("{{", "{").replace("}}", "}") + ", " + EDGES.format("author", "{{da}}").replace("{{", "{").replace("}}", "}")
KW = "WITH w AS (SELECT DISTINCT document_id, keyword FROM {dk}), " + NODES.format("keyword", "w", 100, 2) + ", " + EDGES.format("keyword", "w")


def _co(c: Corpus) -> tuple[DataFrame, DataFrame]:
    nodes = N.top_nodes(c.document_authors, "author", 100)
    return nodes, N.co_edges(c.document_authors, nodes, "author")


def _kw(c: Corpus) -> tuple[DataFrame, DataFrame]:
    nodes = N.top_nodes(c.words, "keyword", 100, 2)
    return nodes, N.co_edges(c.words, nodes, "keyword")


@query(CO + " SELECT * FROM n")
def net_coauthor_nodes(c):
    return _co(c)[0]


@query(CO + " SELECT * FROM e")
def net_coauthor_edges(c):
    return _co(c)[1]


@query(KW + " SELECT * FROM e")
def net_kw_edges(c):
    return _kw(c)[1]


@query("""WITH p AS (SELECT DISTINCT document_id, trim(country) AS country FROM {dc}) SELECT a.country AS source, b.country AS target, count(*) AS weight FROM p a JOIN p b ON a.document_id = b.document_id AND a.country < b.country GROUP BY 1, 2""")
def net_country_edges(c):
    pairs = c.document_countries.select("document_id", F.trim("country").alias("country")).distinct()
    return N.co_edges(pairs, N.top_nodes(pairs, "country", 1000), "country")


@query(CO + " SELECT id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY 1")
def net_degree(c):
    return N.degrees(_co(c)[1])


@query(CO + ", z AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges) SELECT nodes, edges, CASE WHEN nodes > 1 THEN round(2 * edges / (nodes * (nodes - 1)), 4) ELSE 0.0 END AS density FROM z")
def net_density(c):
    return N.density(*_co(c))


@query()
def net_communities(c):
    nodes, edges = _co(c)
    return N.clusters(N.association(edges, nodes, "author"), method="labels")


@query(KW + " SELECT source, target, weight, weight / (a.doc_count * b.doc_count) AS strength FROM e JOIN n a ON a.keyword = source JOIN n b ON b.keyword = target")
def tm_edges(c):
    nodes, edges = _kw(c)
    return N.association(edges, nodes, "keyword").drop("n_source", "n_target")


@query()
def tm_clusters(c):
    nodes, edges = _kw(c)
    return N.clusters(N.association(edges, nodes, "keyword"))


@query(KW + """, s AS (SELECT source, target, weight / (a.doc_count * b.doc_count) AS strength, source % 5 AS x, target % 5 AS y FROM e JOIN n a ON a.keyword = source JOIN n b ON b.keyword = target),
 m AS (SELECT keyword % 5 AS cluster, count(*) AS size FROM n GROUP BY 1), i AS (SELECT x AS cluster, sum(strength) AS w FROM s WHERE x = y GROUP BY 1), o AS (SELECT cluster, sum(strength) AS w FROM (SELECT x AS cluster, strength FROM s WHERE x <> y UNION ALL SELECT y, strength FROM s WHERE x <> y) GROUP BY 1)
 SELECT m.cluster, size, round(coalesce(o.w, 0), 6) AS centrality, round(100 * coalesce(i.w, 0) / size, 6) AS density FROM m LEFT JOIN i ON i.cluster = m.cluster LEFT JOIN o ON o.cluster = m.cluster""")
def tm_metrics(c):
    nodes, edges = _kw(c)
    return N.theme_metrics(N.association(edges, nodes, "keyword"), nodes.select(F.col("keyword").alias("id"), (F.col("keyword") % 5).alias("cluster")))


@query()
def thematic_map(c):
    return N.thematic_map(c.words, c.labels)


KW_YEARS = KW.replace("FROM {dk})", "FROM {dk} JOIN {doc} d ON d.id = document_id WHERE year BETWEEN 1994 AND 1997)")


@query(KW_YEARS + """, s AS (SELECT source, target, weight / (a.doc_count * b.doc_count) AS strength, source % 5 AS x, target % 5 AS y FROM e JOIN n a ON a.keyword = source JOIN n b ON b.keyword = target),
 v AS (SELECT source AS id FROM s UNION SELECT target FROM s), r AS (SELECT id % 5 AS cluster, doc_count, label, row_number() OVER (PARTITION BY id % 5 ORDER BY doc_count DESC, id) AS k FROM v JOIN n ON n.keyword = id JOIN {kw_label} l ON l.keyword = id),
 m AS (SELECT cluster, count(*) AS size, CAST(sum(doc_count) AS BIGINT) AS doc_count, max(CASE WHEN k = 1 THEN label END) AS label FROM r GROUP BY 1), i AS (SELECT x AS cluster, sum(strength) AS w FROM s WHERE x = y GROUP BY 1), o AS (SELECT cluster, sum(strength) AS w FROM (SELECT x AS cluster, strength FROM s WHERE x <> y UNION ALL SELECT y, strength FROM s WHERE x <> y) GROUP BY 1),
 t AS (SELECT m.cluster, label, size, doc_count, round(coalesce(o.w, 0), 6) AS centrality, round(100 * coalesce(i.w, 0) / size, 6) AS density FROM m LEFT JOIN i ON i.cluster = m.cluster LEFT JOIN o ON o.cluster = m.cluster),
 x AS (SELECT round(avg(centrality), 6) AS avg_centrality, round(avg(density), 6) AS avg_density, round(median(centrality), 6) AS median_centrality, round(median(density), 6) AS median_density FROM t)
 SELECT t.*, x.*, CASE WHEN centrality >= median_centrality THEN CASE WHEN density >= median_density THEN 'motor' ELSE 'basic' END WHEN density >= median_density THEN 'niche' ELSE 'emerging' END AS quadrant FROM t, x""")
def tm_quadrants(c):
    """Themes of 1994 to 1997 (the years given the wrong way round), with the clusters fixed by the ids."""
    words = N.of_years(c.words, c.documents, 1997, 1994)
    nodes = N.top_nodes(words, "keyword", 100, 2)
    edges = N.association(N.co_edges(words, nodes, "keyword"), nodes, "keyword")
    return N.themes(edges.withColumn("a", F.col("source") % 5).withColumn("b", F.col("target") % 5), c.labels)


@query()
def thematic_evolution(c):
    return N.thematic_evolution(c.words, c.documents, c.labels, 1998)


FIELDS = """c AS (SELECT DISTINCT document_id, country_id AS id, country AS name FROM {dc}), k AS (SELECT DISTINCT d.document_id, d.keyword AS id, l.label AS name FROM {dk} d JOIN {kw_label} l ON l.keyword = d.keyword WHERE d.type = 'author_keyword'),
 s AS (SELECT id AS document_id, source_title AS id, source_title AS name FROM {doc} WHERE source_title <> ''),
 c2 AS (SELECT DISTINCT document_id, name FROM c WHERE id IN (SELECT id FROM (SELECT DISTINCT document_id, id FROM c) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)),
 k2 AS (SELECT DISTINCT document_id, name FROM k WHERE id IN (SELECT id FROM (SELECT DISTINCT document_id, id FROM k) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)),
 s2 AS (SELECT DISTINCT document_id, name FROM s WHERE id IN (SELECT id FROM (SELECT DISTINCT document_id, id FROM s) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20))"""


@query("WITH " + FIELDS + """ SELECT 0 AS stage, c2.name AS source, k2.name AS target, count(*) AS weight FROM c2 JOIN k2 USING (document_id) GROUP BY 2, 3
 UNION ALL SELECT 1, k2.name, s2.name, count(*) FROM k2 JOIN s2 USING (document_id) GROUP BY 2, 3""")
def three_fields(c):
    country = c.document_countries.select("document_id", F.col("country_id").alias("id"), F.col("country").alias("name"))
    word = c.document_keywords.where("type = 'author_keyword'").join(c.labels, "keyword").select("document_id", F.col("keyword").alias("id"), F.col("label").alias("name"))
    source = c.documents.where("source_title <> ''").select(F.col("id").alias("document_id"), F.col("source_title").alias("id"), F.col("source_title").alias("name"))
    return N.three_fields([country, word, source])


def _matrix(rows: str, cols: str) -> str:
    return f"""WITH r AS ({rows}), c AS ({cols}), p AS (SELECT r.document_id, r.value AS x, c.value AS y FROM r JOIN c ON r.document_id = c.document_id AND r.value <> c.value),
 a AS (SELECT x FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30), b AS (SELECT y FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30)
 SELECT x AS "row", y AS col, count(*) AS weight FROM p WHERE x IN (SELECT x FROM a) AND y IN (SELECT y FROM b) GROUP BY 1, 2"""


AUTHOR_DIM = "SELECT DISTINCT document_id, preferred_name AS value FROM {da} JOIN {author} a ON a.id = author"


def _author_dim(c: Corpus) -> DataFrame:
    return c.kept("author_dimension", lambda: N.dimension(c.document_authors.join(c.view("author").withColumnRenamed("id", "author"), "author"), "preferred_name"))


@query(_matrix(AUTHOR_DIM, "SELECT DISTINCT document_id, country AS value FROM {dc}"))
def matrix_cross(c):
    return N.matrix(_author_dim(c), N.dimension(c.document_countries, "country"))


@query(_matrix(AUTHOR_DIM, AUTHOR_DIM))
def matrix_same(c):
    rows = _author_dim(c)
    return N.matrix(rows, rows)


# ---- classification and search ----

CLASSIFY = f"""g AS (SELECT * FROM {values(GROUPS, 'id, type, position')}), r AS (SELECT * FROM {values(RULES, 'group_id, position, term')}),
 t AS (SELECT d.id AS document_id, d.year, title AS text FROM {{doc}} d JOIN {{title}} ON document_id = d.id),
 h AS (SELECT document_id, group_id, arg_min(term, position) AS term FROM t JOIN r ON contains(lower(text), term) GROUP BY 1, 2),
 a AS (SELECT document_id, CAST(2 AS INT) AS group_id, 'year<1996' AS term FROM t WHERE year <> 0 AND year < 1996
  UNION ALL SELECT t.document_id, 2, h.term FROM t JOIN h ON h.document_id = t.document_id AND h.group_id = 2 WHERE NOT coalesce(year <> 0 AND year < 1996, false)
  UNION ALL SELECT t.document_id, h.group_id, h.term FROM t JOIN h ON h.document_id = t.document_id AND h.group_id > 2
   WHERE NOT coalesce(year <> 0 AND year < 1996, false) AND t.document_id NOT IN (SELECT document_id FROM h WHERE group_id = 2) AND t.document_id IN (SELECT document_id FROM h WHERE group_id = 1)
  UNION ALL SELECT document_id, 2, NULL FROM t WHERE NOT coalesce(year <> 0 AND year < 1996, false) AND document_id NOT IN (SELECT document_id FROM h WHERE group_id IN (1, 2))),
 cl AS (SELECT * FROM a UNION ALL SELECT document_id, NULL, NULL FROM t WHERE document_id NOT IN (SELECT document_id FROM a))"""
ASSIGNED = "cl WHERE group_id IS NOT NULL"


def _assigned(c: Corpus) -> DataFrame:
    return c.kept("assigned", lambda: C.classify(texts(c), groups(c), rules(c)))


@query("WITH " + CLASSIFY + " SELECT * FROM cl")
def classify(c):
    return _assigned(c)


@query("WITH " + CLASSIFY + """ SELECT (SELECT count(DISTINCT document_id) FROM cl) AS total, (SELECT count(*) FROM cl WHERE group_id IS NULL) AS unclassified,
 (SELECT count(*) FROM (SELECT document_id FROM cl WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS multi, (SELECT count(DISTINCT document_id) FROM cl WHERE group_id = 2) AS noise""")
def classify_stats(c):
    return C.classification_stats(_assigned(c), groups(c))


@query("WITH " + CLASSIFY + " SELECT group_id, count(DISTINCT document_id) AS doc_count FROM cl WHERE group_id IS NOT NULL GROUP BY 1")
def cls_counts(c):
    return _assigned(c).where("group_id IS NOT NULL").groupBy("group_id").agg(F.countDistinct("document_id").alias("doc_count"))


@query("WITH " + CLASSIFY + """ SELECT group_id, count(*) AS doc_count, CAST(sum(coalesce(cited_by, 0)) AS BIGINT) AS citations, round(avg(coalesce(cited_by, 0)), 1) AS avg_citations, min(d.year) AS first_year, max(d.year) AS last_year
 FROM cl JOIN {doc} d ON d.id = document_id WHERE group_id IS NOT NULL GROUP BY 1""")
def cls_stats(c):
    return C.group_stats(_assigned(c), c.documents)


@query("WITH " + CLASSIFY + """ SELECT document_id, group_id, coalesce(cited_by, 0) AS cited, CAST(row_number() OVER (PARTITION BY group_id ORDER BY coalesce(cited_by, 0) DESC, document_id) AS INT) AS rank
 FROM cl JOIN {doc} d ON d.id = document_id WHERE group_id IS NOT NULL QUALIFY rank <= 3""")
def cls_top3(c):
    return C.group_top_documents(_assigned(c), c.documents)


@query("WITH " + CLASSIFY + """, j AS (SELECT group_id, source_title, count(*) AS doc_count FROM cl JOIN {doc} d ON d.id = document_id WHERE group_id IS NOT NULL AND source_title <> '' GROUP BY 1, 2)
 SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY doc_count DESC, source_title) AS INT) AS rank FROM j QUALIFY rank <= 5""")
def cls_journals(c):
    return C.group_top_journals(_assigned(c), c.documents)


@query("WITH " + CLASSIFY + " SELECT group_id, d.year, count(*) AS doc_count FROM cl JOIN {doc} d ON d.id = document_id WHERE group_id IS NOT NULL AND d.year > 1900 GROUP BY 1, 2")
def cmp_temporal(c):
    return C.group_years(_assigned(c), c.documents)


@query("WITH " + CLASSIFY + """, s AS (SELECT group_id, count(*) AS doc_count FROM cl WHERE group_id IS NOT NULL GROUP BY 1) SELECT group_id, doc_count, round(100 * doc_count / (SELECT count(*) FROM {doc}), 1) AS percent FROM s""")
def cmp_summary(c):
    n = c.documents.agg(F.count("*").alias("n"))
    return C.group_stats(_assigned(c), c.documents).crossJoin(n).select("group_id", "doc_count", F.round(100 * F.col("doc_count") / F.col("n"), 1).alias("percent"))


@query("WITH " + CLASSIFY + """, o AS (SELECT group_id, lower(trim(l.label)) AS label FROM cl JOIN (SELECT DISTINCT document_id, keyword FROM {dk}) k USING (document_id) JOIN {kw_label} l ON l.keyword = k.keyword WHERE group_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT document_id) >= 2),
 z AS (SELECT group_id, count(*) AS n FROM o GROUP BY 1), b AS (SELECT x.group_id AS a, y.group_id AS b, count(*) AS shared FROM o x JOIN o y ON x.label = y.label AND x.group_id < y.group_id GROUP BY 1, 2)
 SELECT a, b, shared, p.n + q.n - shared AS "either", round(shared / (p.n + q.n - shared), 3) AS jaccard FROM b JOIN z p ON p.group_id = a JOIN z q ON q.group_id = b""")
def group_jaccard(c):
    return C.group_overlap(_assigned(c), c.document_keywords, c.labels)


@query("WITH " + CLASSIFY + """ SELECT group_id, document_id, 'leaves' AS change FROM cl WHERE group_id = 4""")
def expansion_diff(c):
    return C.assignments_diff(_assigned(c), C.classify(texts(c), groups(c), rules(c).where("group_id <> 4")))


@query(f"""WITH l AS (SELECT * FROM {values(LENSES, 'lens, term')}), m AS (SELECT DISTINCT lens, document_id FROM {{title}} JOIN {{doc}} d ON d.id = document_id JOIN l ON regexp_matches(title, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
 r AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY document_id) AS rn FROM m) SELECT lens, count(*) AS doc_count, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY document_id) FILTER (WHERE rn <= 5) AS samples FROM r GROUP BY 1""")
def lens_matches(c):
    return C.lens_matches(texts(c), c.spark.createDataFrame(LENSES, "lens string, term string"))


@query("SELECT document_id, year, title AS text FROM {title} JOIN {doc} d ON d.id = document_id WHERE contains(title, 'red bolt') AND year = 1998 ORDER BY year DESC, title, document_id LIMIT 500")
def doc_search(c):
    return C.document_search(texts(c), title="Red bolt", year=1998)


# ---- repeats, import and upkeep ----


@query("""SELECT md5(trim(lower(title))) AS title_md5, year, count(*) AS n, min(id) AS first_id FROM {doc} JOIN {title} ON document_id = id GROUP BY 1, 2 HAVING count(*) > 1""")
def possible_repeats(c):
    return I.possible_repeats(c.documents, c.titles)


DEDUP = """x AS (SELECT d.id, CASE WHEN trim(coalesce(doi, '')) <> '' THEN md5('doi:' || lower(trim(doi))) WHEN trim(coalesce(title, '')) <> '' AND year IS NOT NULL THEN md5(lower(trim(title)) || ':' || year)
 ELSE md5('ext:orders:' || d.id) END AS hash FROM {doc} d LEFT JOIN {title} ON document_id = d.id)"""


def _hashed(c: Corpus) -> DataFrame:
    rows = c.documents.join(c.titles.withColumnRenamed("document_id", "id"), "id", "left")
    return rows.select("id", I.dedup_key(F.col("doi"), F.lit(False), F.lit("orders"), F.col("id").cast("string"), F.col("title"), F.col("year")).alias("hash"))


@query("WITH " + DEDUP + " SELECT * FROM x")
def dedup_hash(c):
    return _hashed(c)


@query("WITH " + DEDUP + ", r AS (SELECT id, hash, min(id) OVER (PARTITION BY hash) AS kept FROM x) SELECT id, kept, CASE WHEN id = kept THEN 'imported' ELSE 'hash' END AS outcome FROM r")
def dedup_import(c):
    return M.first_of_each(_hashed(c), "hash", "id")


@query("""WITH o AS (SELECT l_orderkey AS document_id, lower(trim(p_name)) AS term, CASE p_size % 2 WHEN 0 THEN 0 ELSE 1 END AS kind, l_linenumber AS position, l_partkey AS keyword_id FROM lineitem JOIN part ON p_partkey = l_partkey)
 SELECT document_id, term, kind, position, keyword_id FROM o QUALIFY row_number() OVER (PARTITION BY document_id, term ORDER BY kind, position, keyword_id) = 1""")
def link_build(c):
    rows = c.view("document_keyword_position").join(c.view("keyword").select(F.col("id").alias("keyword_id"), "display", "type"), "keyword_id")
    return M.keyword_links(rows.select("document_id", F.col("display").alias("term"), F.when(F.col("type") == "author_keyword", 0).otherwise(1).alias("kind"), "position", "keyword_id"))


@query("""SELECT count(*) AS total, count(CASE WHEN d.id IS NULL THEN 1 END) AS without_parent FROM {document_author} l LEFT JOIN {doc} d ON d.id = l.document_id""")
def orphan_audit(c):
    rows = c.view("document_author").join(c.documents.select(F.col("id").alias("document_id"), F.lit(1).alias("known")), "document_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count(F.when(F.col("known").isNull(), 1)).alias("without_parent"))


@query("""WITH j AS (SELECT DISTINCT '1000' || CAST(CAST(1000 + floor(sqrt(c_custkey)) AS INT) AS VARCHAR) AS issn, CASE CAST(floor(sqrt(c_custkey)) AS INT) % 3 WHEN 0 THEN 'A1' WHEN 1 THEN 'B2' END AS stratum FROM customer)
 SELECT d.id, d.issn, j.stratum FROM {doc} d LEFT JOIN j ON j.issn = replace(replace(lower(d.issn), '-', ''), ' ', '') AND j.stratum IS NOT NULL""")
def qualis_enrich(c):
    return M.journal_strata(c.documents, _journals(c)).select("id", "issn", "stratum")


@query("""WITH j AS (SELECT DISTINCT '1000' || CAST(CAST(1000 + floor(sqrt(c_custkey)) AS INT) AS VARCHAR) AS issn FROM customer WHERE CAST(floor(sqrt(c_custkey)) AS INT) % 3 < 2)
 SELECT DISTINCT replace(issn, '-', '') AS issn FROM {doc} WHERE issn IS NOT NULL AND replace(issn, '-', '') NOT IN (SELECT issn FROM j)""")
def missing_journals(c):
    return M.missing_journals(c.documents, _journals(c))


def _journals(c: Corpus) -> DataFrame:
    """Invented strata of the journals: by the number in their ISSN, a third has none."""
    n = F.floor(F.sqrt("c_custkey")).cast("int")
    rows = c.source("customer").select(F.concat(F.lit("1000-"), (n + 1000).cast("string")).alias("issn"), F.when(n % 3 == 0, "A1").when(n % 3 == 1, "B2").alias("stratum"))
    return rows.where("stratum IS NOT NULL")


@query("""WITH p AS (SELECT id, preferred_name, lower(substr(preferred_name, 1, 4)) || '|' AS k FROM {author}), s AS (SELECT a.id AS id1, b.id AS id2, 1 - levenshtein(lower(a.preferred_name), lower(b.preferred_name)) / greatest(length(a.preferred_name), length(b.preferred_name)) AS score FROM p a JOIN p b ON a.k = b.k AND a.id < b.id)
 SELECT id1, id2, round(score, 4) AS score FROM s WHERE score >= 0.85""")
def similar_authors(c):
    return S.similar_pairs(c.view("author").select("id", F.col("preferred_name").alias("name")), S.block_key_column("name")).drop("exact")


@query("""WITH n AS (SELECT author AS id, count(DISTINCT document_id) AS n FROM {da} GROUP BY 1), p AS (SELECT a.id, preferred_name AS name, lower(substr(preferred_name, 1, 4)) AS k, n FROM {author} a JOIN n ON n.id = a.id),
 s AS (SELECT a.id AS id1, b.id AS id2, a.n > b.n OR (a.n = b.n AND (a.name < b.name OR (a.name = b.name AND a.id < b.id))) AS first, 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)) AS score FROM p a JOIN p b ON a.k = b.k AND a.id < b.id)
 SELECT CASE WHEN first THEN id1 ELSE id2 END AS keep, CASE WHEN first THEN id2 ELSE id1 END AS discard, round(score * 100, 1) AS similarity FROM s WHERE score >= 0.85 ORDER BY 3 DESC, 1, 2 LIMIT 5000""")
def similar_authors_report(c):
    return S.similar_authors(c.view("author").select("id", F.col("preferred_name").alias("name")), c.document_authors)


@query()
def block_keys(c):
    return c.view("author").select("id", S.block_key_column("preferred_name").alias("key"))


@query()
def clean_texts(c):
    """Display and comparison forms of every document's text."""
    from marginalia.functions.text import clean_display_udf, normalize_udf

    docs = c.source("documents")
    return docs.select("doc_id", F.md5(clean_display_udf("text")).alias("display_md5"), F.md5(normalize_udf("text")).alias("normal_md5"))


# ---- treatment and enrichment ----


@query("""WITH t AS (SELECT d.id, year, trim(coalesce(doi, '')) <> '' AS has, coalesce(cited_by, -1) AS cited, title FROM {doc} d JOIN {title} ON document_id = d.id WHERE year IS NOT NULL),
 s AS (SELECT a.id AS id1, b.id AS id2, a.title < b.title OR (a.title = b.title AND a.id < b.id) AS ahead, (a.has AND NOT b.has) OR a.cited >= b.cited AS a_stays, (b.has AND NOT a.has) OR b.cited >= a.cited AS b_stays,
  1 - levenshtein(lower(a.title), lower(b.title)) / greatest(length(a.title), length(b.title)) AS score FROM t a JOIN t b ON a.year = b.year AND a.id < b.id AND length(a.title) BETWEEN 0.84 * length(b.title) AND length(b.title) / 0.84),
 f AS (SELECT *, CASE WHEN ahead THEN a_stays ELSE NOT b_stays END AS first FROM s WHERE score >= 0.85)
 SELECT CASE WHEN first THEN id1 ELSE id2 END AS keep, CASE WHEN first THEN id2 ELSE id1 END AS discard, round(score * 100, 1) AS similarity FROM f ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def dup_documents(c):
    return S.duplicate_documents(c.documents.join(c.titles.withColumnRenamed("document_id", "id"), "id"))


@query("""WITH k AS (SELECT k.id, k.display AS term, count(DISTINCT e.document_id) AS n FROM {keyword} k JOIN {dk} e ON e.keyword = k.id WHERE k.type = 'author_keyword' AND k.thesaurus_concept_id IS NULL GROUP BY 1, 2),
 p AS (SELECT a.id AS id1, b.id AS id2, a.n AS n1, b.n AS n2, CASE WHEN a.term = b.term THEN 1 ELSE 1 - levenshtein(a.term, b.term) / greatest(length(a.term), length(b.term)) END AS s
  FROM k a JOIN k b ON left(a.term, 4) = left(b.term, 4) AND (a.term < b.term OR (a.term = b.term AND a.id < b.id)))
 SELECT CASE WHEN n1 >= n2 THEN id1 ELSE id2 END AS keep, CASE WHEN n1 >= n2 THEN id2 ELSE id1 END AS discard, round(s * 100, 1) AS similarity, 'same_type' AS match_type FROM p WHERE s >= 0.85 ORDER BY 3 DESC, 1, 2 LIMIT 5000""")
def similar_keywords(c):
    own = c.view("keyword").where("type = 'author_keyword' AND thesaurus_concept_id IS NULL").select("id", F.col("display").alias("term"))
    docs = c.document_keywords.groupBy(F.col("keyword").alias("id")).agg(F.countDistinct("document_id").alias("doc_count"))
    return S.similar_keywords(own.join(docs, "id"))


#: How the raw forms that are treated are made of the tables' names, for Spark and DuckDB alike.
RAW_KEYWORDS = """SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN concat(' ', upper(substr(p_name, 1, 1)), substr(p_name, 2), '.') WHEN 1 THEN concat(p_name, ' 2') WHEN 2 THEN '[12]' WHEN 3 THEN p_name ELSE concat(p_name, 's') END AS original,
 p_name AS display, CASE p_size % 5 WHEN 4 THEN concat(p_name, 's') ELSE p_name END AS normalized, CASE p_size % 2 WHEN 0 THEN 'author_keyword' ELSE 'indexed_keyword' END AS type, CASE p_partkey % 7 WHEN 0 THEN 0 ELSE 1 END AS status FROM {part}"""
RAW_PLACES = """SELECT l_orderkey AS document_id, CASE l_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'ny 10027 USA' WHEN 2 THEN 'TX' WHEN 3 THEN concat('City ', CAST(l_suppkey % 5 AS STRING)) WHEN 4 THEN concat('State ', CAST(l_suppkey % 4 AS STRING)) ELSE 'UK' END AS raw
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""
RAW_HOUSES = """SELECT l_orderkey AS document_id, CASE l_suppkey % 6 WHEN 0 THEN concat('INSTITUTION  ', CAST(l_suppkey % 50 AS STRING)) WHEN 1 THEN concat('Unit ', CAST(l_suppkey % 9 AS STRING)) WHEN 2 THEN '12 Main St' WHEN 3 THEN concat('Company ', CAST(l_suppkey % 5 AS STRING))
 WHEN 4 THEN concat('Inst. ', CAST(l_suppkey % 60 AS STRING)) ELSE 'Institution of nothing' END AS raw FROM {lineitem}"""


def _raw(c: Corpus, sql: str) -> DataFrame:
    return c.spark.sql(sql, **{n: c.view(n) for n in ("part", "lineitem", "supplier", "nation") if f"{{{n}}}" in sql})


def _raw_keywords(c: Corpus) -> DataFrame:
    return c.kept("raw_keywords", lambda: _raw(c, RAW_KEYWORDS))


@query(f"""WITH k AS ({RAW_KEYWORDS}), f AS (SELECT *, original <> '[12]' AS valid, trim(trim(lower(original)), '.') AS nd FROM k), d AS (SELECT *, regexp_replace(nd, '^new ', 'New ') AS shown, valid AND (regexp_replace(nd, '^new ', 'New ') <> display OR nd <> normalized) AS dirty FROM f),
 g AS (SELECT type, nd, min(id) AS gets FROM d WHERE dirty GROUP BY 1, 2), h AS (SELECT type, normalized, min(id) AS h1, max(id) AS h2 FROM k GROUP BY 1, 2),
 m AS (SELECT d.*, CASE WHEN dirty THEN coalesce(nullif(h1, id), nullif(h2, id), CASE WHEN gets < id THEN gets END) END AS merged_into FROM d LEFT JOIN g ON g.type = d.type AND g.nd = d.nd LEFT JOIN h ON h.type = d.type AND h.normalized = d.nd)
 SELECT id, type, CASE WHEN NOT valid THEN 'invalid' WHEN merged_into IS NOT NULL THEN 'merged' WHEN dirty THEN 'cleaned' ELSE 'kept' END AS action, CASE WHEN NOT valid THEN 'numeric_reference' END AS reason,
  CASE WHEN valid THEN shown ELSE '' END AS new_display, CASE WHEN valid THEN nd ELSE '' END AS new_normalized, merged_into, CASE WHEN valid AND contains(nd, '2') THEN 'contains_number' END AS review_reasons FROM m""")
def kw_clean(c):
    return T.cleaned_keywords(_raw_keywords(c))


@query(f"""WITH k AS ({RAW_KEYWORDS}), s AS (SELECT count(*) AS n FROM (SELECT normalized FROM k GROUP BY 1 HAVING count(*) > 1)), v AS (SELECT k.*, r.thesaurus_concept_id, r.keyword_concept_id FROM k JOIN {{keyword}} r ON r.id = k.id),
 l AS (SELECT count(*) AS links, count(DISTINCT document_id) AS documents FROM {{document_keyword}})
 SELECT count(*) AS total, 0 AS no_display, 0 AS no_normalized, count(CASE WHEN original LIKE ' %' OR original = '[12]' THEN 1 END) AS dirty, count(CASE WHEN original = '[12]' THEN 1 END) AS invalid, count(CASE WHEN original LIKE '% 2' THEN 1 END) AS suspicious,
  count(CASE WHEN thesaurus_concept_id IS NULL THEN 1 END) AS no_concept, count(thesaurus_concept_id) AS with_concept, count(CASE WHEN thesaurus_concept_id IS NULL AND keyword_concept_id IS NOT NULL THEN 1 END) AS keyword_concept,
  count(CASE WHEN type = 'author_keyword' THEN 1 END) AS author_keywords, count(CASE WHEN type = 'indexed_keyword' THEN 1 END) AS indexed_keywords, any_value(s.n) AS duplicates, any_value(links) AS links, any_value(documents) AS documents,
  count(CASE WHEN status = 0 THEN 1 END) AS inactive, (SELECT count(*) FROM {{concept}}) AS concepts, (SELECT count(*) FROM {{keyword}} k JOIN {{concept}} c ON c.id = k.thesaurus_concept_id) AS labels,
  (SELECT count(*) FROM {{keyword}} WHERE id % 3 = 0 AND id % 4 < 3) AS pending FROM v, s, l""")
def kw_diagnosis(c):
    """Of the raw forms, as no other form is kept for them."""
    own = _raw_keywords(c).withColumn("display", F.col("original")).join(c.view("keyword").select("id", "thesaurus_concept_id", "keyword_concept_id"), "id")
    k = c.view("keyword")
    matches = k.select(F.when(F.col("id") % 4 < 3, "keyword").otherwise("author").alias("entity_type"), F.when(F.col("id") % 3 == 0, "pending").otherwise("accepted").alias("status"))
    return T.diagnosis(own, c.view("document_keyword"), c.view("concept"), k.select(F.col("thesaurus_concept_id").alias("concept_id")), matches)


@query()
def thesaurus_match(c):
    concepts = c.view("concept").select("id", F.lower("label").alias("normalized"), "label")
    other = concepts.select(F.concat("normalized", F.lit("es")).alias("normalized"), F.concat("label", F.lit("es")).alias("label"), F.col("id").alias("concept_id"))
    return T.thesaurus_matches(_raw_keywords(c), other, concepts)


@query()
def fuzzy_score(c):
    """Of every raw keyword and its name."""
    rows = _raw_keywords(c)
    return rows.select("id", F.round(T.fuzzy_score(F.col("normalized"), F.col("display"), F.col("normalized"), F.col("display")), 6).alias("score"))


@query(f"""WITH k AS ({RAW_KEYWORDS}), a AS (SELECT normalized, type, min(id) AS suggestion FROM k WHERE status = 1 GROUP BY 1, 2) SELECT k.id, k.normalized, k.type, a.suggestion FROM (SELECT * FROM k WHERE status = 0 ORDER BY id LIMIT 100) k LEFT JOIN a ON a.normalized = k.normalized AND a.type = k.type""")
def review_suggestions(c):
    return T.review_suggestions(_raw_keywords(c), ["normalized", "type"])


@query("""WITH a AS (SELECT s_suppkey AS id, concat('supplier ', CAST(s_suppkey % 40 AS VARCHAR)) AS key, CAST(s_suppkey % 3 > 0 AS INT) AS status FROM supplier), d AS (SELECT author_id, count(DISTINCT document_id) AS n FROM {document_author} GROUP BY 1),
 r AS (SELECT id, key, row_number() OVER w AS rn, first_value(id) OVER w AS master, count(*) OVER (PARTITION BY key) AS m FROM a LEFT JOIN d ON author_id = id WINDOW w AS (PARTITION BY key ORDER BY coalesce(n, 0) DESC, status DESC, id))
 SELECT id, master, key FROM r WHERE m > 1""")
def author_masters(c):
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "SUPPLIER, ").otherwise("Supplier "), (F.col("s_suppkey") % 40).cast("string"))
    return T.author_masters(c.source("supplier").select(F.col("s_suppkey").alias("id"), name.alias("preferred_name"), F.lit("").alias("normalized"), (F.col("s_suppkey") % 3 > 0).cast("int").alias("status")), c.view("document_author"))


@query("""SELECT d.id, d.year, t.title, count(*) OVER () AS total, count(*) OVER () > 70 AS has_more FROM {doc} d JOIN {title} t ON t.document_id = d.id WHERE d.year = 1998 ORDER BY t.title, d.id LIMIT 50 OFFSET 20""")
def work_list(c):
    rows = c.documents.where("year = 1998").join(c.titles.withColumnRenamed("document_id", "id"), "id").select("id", "year", "title")
    return T.page(rows, [F.desc("year"), "title", "id"], 50, 20)


@query("""SELECT e.document_id, coalesce(c.label, nullif(n.display, ''), k.display, k.original) AS label, coalesce(nullif(k.display, ''), k.original) AS plain_label FROM {document_keyword} e JOIN {doc} d ON d.id = e.document_id JOIN {keyword} k ON k.id = e.keyword_id
 LEFT JOIN {concept} c ON c.id = k.thesaurus_concept_id LEFT JOIN {keyword} n ON n.id = k.keyword_concept_id""")
def matrix_label(c):
    """A keyword's label with the thesaurus (concept, grouping keyword, own form) and without."""
    k = c.view("keyword")
    own = F.coalesce(F.nullif("display", F.lit("")), "original")
    rows = k.select(F.col("id").alias("keyword_id"), own.alias("plain_label"), "keyword_concept_id", "thesaurus_concept_id")
    rows = rows.join(c.view("concept").select(F.col("id").alias("thesaurus_concept_id"), F.col("label").alias("preferred")), "thesaurus_concept_id", "left").join(k.select(F.col("id").alias("keyword_concept_id"), F.nullif("display", F.lit("")).alias("grouped")), "keyword_concept_id", "left")
    return c.of_project("document_keyword").join(rows, "keyword_id").select("document_id", F.coalesce("preferred", "grouped", "plain_label").alias("label"), "plain_label")


def _houses(c: Corpus, raw: DataFrame | None = None) -> DataFrame:
    s = c.source("supplier").select(F.col("s_suppkey").alias("k"))
    named = lambda kind, n, id_, *more: s.select(id_.alias("id"), F.concat(F.lit(f"{kind} "), (F.col("k") % n).cast("string")).alias("name"), *more).distinct()
    return E.institutions(
        _raw(c, RAW_HOUSES) if raw is None else raw, c.view("institution").select("id", F.col("official_name").alias("name")), named("Inst.", 60, F.col("k") % 60 % 50), named("Company", 5, F.col("k") % 5), named("Unit", 9, F.col("k") % 9, (F.col("k") % 9 + 100).alias("parent")),
    )


HOUSES = f"""r AS ({RAW_HOUSES}), s AS (SELECT s_suppkey AS k FROM supplier), n AS (
  SELECT DISTINCT 'institution' || ' ' || CAST(k % 50 AS VARCHAR) AS key, 'institution' AS kind, k % 50 AS entity_id, k % 50 AS institution_id FROM s UNION SELECT 'inst ' || CAST(k % 60 AS VARCHAR), 'institution', k % 60 % 50, k % 60 % 50 FROM s
  UNION SELECT 'company ' || CAST(k % 5 AS VARCHAR), 'organization', k % 5, NULL FROM s UNION SELECT 'unit ' || CAST(k % 9 AS VARCHAR), 'unit', k % 9, k % 9 + 100 FROM s),
 x AS (SELECT document_id, raw, kind, entity_id, institution_id FROM (SELECT *, replace(replace(lower(raw), '.', ''), '  ', ' ') AS key FROM r WHERE raw <> '12 Main St') q LEFT JOIN n USING (key))"""


@query(f"WITH {HOUSES} SELECT * FROM x")
def enrich_inst(c):
    return _houses(c)


@query(f"WITH {HOUSES} SELECT raw, count(*) AS n FROM x WHERE kind IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def unresolved(c):
    return E.unresolved(_houses(c), F.col("kind").isNotNull())


def _places(c: Corpus, raw: DataFrame) -> DataFrame:
    s = c.source("supplier").select(F.col("s_suppkey").alias("k"))
    states = s.select((F.col("k") % 4).alias("id"), F.concat(F.lit("State "), (F.col("k") % 4).cast("string")).alias("name"), (F.col("k") % 4 + 10).alias("country_id")).distinct()
    states = states.union(c.spark.createDataFrame([(50, "TX", 24), (51, "UK", 24)], "id long, name string, country_id long"))
    cities = s.select((F.col("k") % 5 + 200).alias("id"), F.concat(F.lit("City "), (F.col("k") % 5).cast("string")).alias("name"), (F.col("k") % 5 + 60).alias("state_id"), (F.col("k") % 5).alias("country_id")).distinct()
    return E.places(raw, c.source("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), states, cities, 24)


@query(f"""WITH r AS ({RAW_PLACES}), n AS (SELECT lower(n_name) AS k, n_nationkey AS id FROM nation)
 SELECT document_id, raw, CAST(CASE WHEN raw IN ('ny 10027 USA', 'TX') THEN 24 WHEN raw LIKE 'City %' THEN CAST(right(raw, 1) AS INT) WHEN raw LIKE 'State %' THEN CAST(right(raw, 1) AS INT) + 10 ELSE n.id END AS BIGINT) AS country_id,
  CASE raw WHEN 'ny 10027 USA' THEN 'NY' WHEN 'TX' THEN 'TX' END AS state, CAST(CASE WHEN raw = 'TX' THEN 50 WHEN raw LIKE 'City %' THEN CAST(right(raw, 1) AS INT) + 60 WHEN raw LIKE 'State %' THEN CAST(right(raw, 1) AS INT) END AS BIGINT) AS state_id,
  CAST(CASE WHEN raw LIKE 'City %' THEN CAST(right(raw, 1) AS INT) + 200 END AS BIGINT) AS city_id FROM r LEFT JOIN n ON n.k = lower(raw)""")
def enrich_country(c):
    return _places(c, _raw(c, RAW_PLACES))


@query()
def color_board(c):
    rows = groups(c).withColumn("color", F.when(F.col("id") % 2 == 0, "#FF0000").otherwise("")).withColumn("description", F.when(F.col("id") > 3, F.concat(F.lit("x | Categoria "), F.col("id").cast("string"), F.lit(": colours"))))
    return E.color_board(rows, _assigned(c))


@query()
def term_expand(c):
    """The rules' terms with the labels and variations that the tables' names give them."""
    concepts = c.view("concept").select("id", "label", F.lower("label").alias("normalized"))
    labels = concepts.select(F.col("id").alias("concept_id"), F.explode(F.array("label", F.concat("label", F.lit(" part")))).alias("label")).withColumn("normalized", F.lower("label"))
    raw = _raw_keywords(c)
    own = rules(c).withColumn("term", F.when(F.col("group_id") == 4, "small bolt").otherwise(F.col("term")))
    return T.term_expansion(own, labels, concepts, raw.select("id", F.col("display").alias("normalized"), "status"), raw.select(F.col("id").alias("keyword_id"), F.col("original").alias("variation"), "status"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM {doc}), a AS (SELECT document_id, count(*) AS authors FROM {document_author} GROUP BY 1)
 SELECT CAST(rn + 9999999 AS BIGINT) AS id, 9 AS project_id, year, title_md5, coalesce(authors, 0) AS authors FROM (SELECT o.*, md5(coalesce(doi, '')) AS title_md5, a.authors FROM o LEFT JOIN a ON a.document_id = o.id)""")
def project_copy(c):
    docs, links, _ = E.copy_project(c.view("document"), {"author": c.view("document_author")}, c.view("authority_mapping"), c.project_id, 9, 10_000_000)
    n = links["author"].groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("authors"))
    return docs.select("id", "project_id", "year", F.md5(F.coalesce("doi", F.lit(""))).alias("title_md5")).join(n, "id", "left").withColumn("authors", F.coalesce("authors", F.lit(0)))


FILTERED = [(1, "validator", 0, None, None, None, None, None, None), (2, "noise", 1, None, None, None, None, None, None), (3, "normal", 2, ["a1"], None, 1999, None, None, None), (4, "normal", 3, None, 1998, None, "Asia", None, None), (5, "normal", 4, None, None, None, None, ["CHINA", "India"], ["pub"]), (6, "normal", 5, None, None, None, None, None, ["private"])]


@query("WITH " + CLASSIFY + """, m AS (SELECT i.document_id, bool_or(n.nature = 'public') AS pub, bool_or(n.nature = 'private') AS priv FROM {document_institution} i JOIN {institution} n ON n.id = i.institution_id GROUP BY 1),
 f AS (SELECT cl.* FROM cl JOIN {doc} d ON d.id = document_id LEFT JOIN m USING (document_id) WHERE CASE group_id WHEN 3 THEN d.qualis = 'A1' AND d.year <= 1999 WHEN 4 THEN d.year >= 1998 AND document_id IN (SELECT document_id FROM {dc} WHERE continent = 'ASIA')
  WHEN 5 THEN pub AND document_id IN (SELECT document_id FROM {dc} WHERE country IN ('CHINA', 'INDIA')) WHEN 6 THEN priv ELSE true END)
 SELECT * FROM f UNION ALL SELECT DISTINCT document_id, NULL, NULL FROM cl WHERE document_id NOT IN (SELECT document_id FROM f)""")
def classify_filtered(c):
    """With filters of stratum, years, continent, countries and natures."""
    rows = c.spark.createDataFrame(FILTERED, "id int, type string, position int, qualis array<string>, start_year int, end_year int, continent string, country_ids array<string>, nature array<string>")
    where = c.document_countries.groupBy("document_id").agg(F.collect_set("continent").alias("continents"), F.collect_set("country").alias("countries"))
    kinds = c.document_institutions.join(c.view("institution").select(F.col("id").alias("institution_id"), "nature").where("nature IS NOT NULL"), "institution_id").groupBy("document_id").agg(F.collect_set("nature").alias("natures"))
    docs = texts(c).join(c.documents.select(F.col("id").alias("document_id"), "qualis"), "document_id").join(where, "document_id", "left").join(kinds, "document_id", "left")
    return C.classify(docs, rows, rules(c))


# ---- reports and pages of the web application ----


@query("""WITH p AS (SELECT DISTINCT l.document_id, city_id, coalesce(cited_by, 0) AS cited FROM {document_city} l JOIN {doc} d ON d.id = l.document_id)
 SELECT city_id, c.name AS city, s.name AS state, s.sigla AS state_sigla, n.name AS country, continent, count(*) AS doc_count, CAST(sum(cited) AS BIGINT) AS citations
 FROM p JOIN {city} c ON c.id = city_id JOIN {country} n ON n.id = c.country_id LEFT JOIN {state} s ON s.id = c.state_id GROUP BY ALL""")
def cities_report(c):
    return I.cities_report(c.view("document_city"), c.documents, c.view("city"), c.view("state"), c.view("country"))


ASSIGNED = SQL["classify"]
AUTHOR_STRING = SQL["author_string"]


SQL["classified_page"] = f"""WITH a AS ({ASSIGNED}), t AS (SELECT a.document_id, a.term, o.* EXCLUDE (id) FROM a JOIN ({oracle("SELECT id, year, source_title, cited_by FROM {doc}")}) o ON o.id = a.document_id
 WHERE a.group_id = 4 ORDER BY cited_by DESC NULLS LAST, year DESC NULLS LAST, document_id, term LIMIT 100 OFFSET 100)
 SELECT t.*, s.authors FROM t LEFT JOIN ({AUTHOR_STRING}) s ON s.document_id = t.document_id"""


@query()
def classified_page(c):
    """The second page of a group."""
    return C.classified_page(_assigned(c), c.documents, c.author_links, c.view("author"), 4, 2)


SQL["classified_move"] = f"""WITH a AS ({ASSIGNED}), m AS (SELECT min(document_id) AS id FROM a WHERE group_id = 3)
 SELECT document_id, CASE WHEN document_id = m.id AND group_id = 3 THEN 6 ELSE group_id END AS group_id, term, document_id = m.id AND (group_id = 3 OR group_id = 6) AS manual
 FROM a, m WHERE NOT (document_id = m.id AND group_id = 3 AND EXISTS (SELECT 1 FROM a b WHERE b.document_id = m.id AND b.group_id = 6))"""


@query()
def classified_move(c):
    """All assignments after the first document of a group was moved to another."""
    rows = _assigned(c).withColumn("manual", F.lit(False))
    first = rows.where("group_id = 3").agg(F.min("document_id")).first()[0]
    return C.move(rows, first, 3, 6)


#: How the log of a treatment is made of the keywords.
TREATMENT_LOG = """SELECT id * 2 AS id, id AS keyword_id, CASE id % 7 WHEN 0 THEN 'exact_label_matched' WHEN 1 THEN 'exact_concept_matched' WHEN 2 THEN 'fuzzy_auto_matched' WHEN 3 THEN 'invalid' ELSE 'fuzzy_review_required' END AS action,
 CASE WHEN id % 5 = 0 THEN 'applied' ELSE 'pending' END AS status, thesaurus_concept_id AS concept_id, concat('Concept ', CAST(id % 80 AS STRING)) AS concept, display AS term FROM {keyword}"""


def _log(c: Corpus) -> DataFrame:
    return c.kept("treatment_log", lambda: c.spark.sql(TREATMENT_LOG, keyword=c.view("keyword")))


@query(f"""WITH l AS ({TREATMENT_LOG}), g AS (SELECT * FROM l WHERE action IN ('exact_label_matched', 'exact_concept_matched', 'fuzzy_auto_matched')), f AS (SELECT concept, min(id) AS k, count(*) AS total FROM g GROUP BY 1 ORDER BY 2 LIMIT 50),
 r AS (SELECT concept, total, row_number() OVER (PARTITION BY concept ORDER BY id) AS place, term FROM g JOIN f USING (concept)) SELECT * FROM r WHERE place <= 200""")
def treatment_report(c):
    return T.grouped_terms(_log(c))


@query(f"WITH l AS ({TREATMENT_LOG}) SELECT id, term, (SELECT count(*) FROM l WHERE action = 'invalid') AS total FROM l WHERE action = 'invalid' ORDER BY id LIMIT 500")
def treatment_invalid(c):
    return T.listed_entries(_log(c), "invalid").select("id", "term", "total")


#: The decisions on the log.
DECISIONS = """SELECT id AS log_id, CASE id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, concat(term, ' part') AS new_display FROM {log} WHERE id % 4 = 0"""


@query(f"""WITH l AS ({TREATMENT_LOG}), d AS ({DECISIONS.replace("{log}", "l")}), j AS (SELECT l.*, CASE WHEN decision = 'approve' AND concept_id IS NOT NULL THEN 1 WHEN decision = 'reject' THEN 2 WHEN decision = 'edit' THEN 3 END AS k, new_display
  FROM l LEFT JOIN d ON log_id = id AND action = 'fuzzy_review_required' AND status = 'pending')
 SELECT j.id, CASE k WHEN 1 THEN 'manual_approved' WHEN 2 THEN 'manual_rejected' WHEN 3 THEN 'cleaned' ELSE action END AS action, CASE k WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' WHEN 3 THEN 'applied' ELSE status END AS status,
  CASE k WHEN 3 THEN new_display ELSE w.display END AS display, CASE k WHEN 3 THEN lower(new_display) ELSE normalized END AS normalized, CASE k WHEN 1 THEN concept_id ELSE thesaurus_concept_id END AS thesaurus_concept_id
 FROM j JOIN {{keyword}} w ON w.id = keyword_id""")
def treatment_decisions(c):
    log = _log(c)
    new_log, words = T.decide(log, c.view("keyword"), c.spark.sql(DECISIONS, log=log))
    return new_log.select("id", "keyword_id", "action", "status").join(words.select(F.col("id").alias("keyword_id"), "display", "normalized", "thesaurus_concept_id"), "keyword_id").drop("keyword_id")


# ---- import with all rules ----

#: The records of an import, of few titles, from two sources of which one has strict ids; and what is there.
RECORDS = """SELECT id, CASE WHEN id % 6 = 0 THEN concat('10.1/', CAST(id % 5000 AS STRING)) END AS doi, CASE WHEN id % 2 = 0 THEN 'Alpha' ELSE 'beta' END AS source, CASE WHEN id % 10 < 9 THEN CAST(id % 9000 AS STRING) END AS external_id,
 concat('Title ', CAST(id % 1500 AS STRING)) AS title, CASE WHEN id % 40 > 0 THEN year END AS year, id % 4 = 1 AS strict FROM {document} WHERE project_id = 2"""
OLD = 400
IDENTITIES = """SELECT id, doi, source, strict, CASE WHEN doi IS NOT NULL THEN md5('doi:' || lower(doi)) WHEN strict THEN ext WHEN ty IS NOT NULL THEN ty WHEN ext IS NOT NULL THEN ext ELSE md5('title:' || lower(title)) END AS hash, ty AS title_year FROM (
 SELECT id, doi, lower(source) AS source, strict AND external_id IS NOT NULL AS strict, md5('ext:' || lower(source) || ':' || external_id) AS ext, CASE WHEN year IS NOT NULL THEN md5(lower(title) || ':' || year) END AS ty, title FROM r)"""


def _round(k: int) -> str:
    """SQL of one round of import_outcomes: from s{k} to s{k + 1}."""
    return f"""h{k} AS (SELECT hash, min(id) AS hid, min(own) AS own FROM s{k} WHERE accepted GROUP BY 1), t{k} AS (SELECT title_year, id AS tid, source AS tsource, kind AS tkind, doi IS NOT NULL AS tdoi FROM (SELECT *, row_number() OVER (PARTITION BY title_year ORDER BY id) AS n FROM s{k} WHERE accepted AND title_year IS NOT NULL) WHERE n = 1),
 j{k} AS (SELECT s.id, s.doi, s.source, s.strict, s.hash, s.title_year, s.kind, s.known, s.own, NOT s.known AND coalesce(hid < s.id, false) AS rep, hid, tid,
  NOT s.known AND coalesce(tid < s.id AND NOT (s.doi IS NOT NULL AND tdoi) AND CASE WHEN s.strict THEN tsource <> s.source OR tkind = 'title' ELSE tkind = 'ext' END, false) AS tit FROM s{k} s LEFT JOIN h{k} h ON h.hash = s.hash LEFT JOIN t{k} t ON t.title_year = s.title_year),
 s{k + 1} AS (SELECT id, doi, source, strict, hash, title_year, kind, known, own, NOT rep AND NOT tit AS accepted, CASE WHEN rep THEN hid WHEN tit THEN tid END AS kept FROM j{k})"""


ROUNDS = 6


@query(f"WITH r AS ({RECORDS}), i AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN hash = title_year THEN 'title' ELSE 'ext' END AS kind FROM ({IDENTITIES})), o AS (SELECT id FROM i ORDER BY id LIMIT {OLD}), "
       f"s0 AS (SELECT i.*, o.id IS NOT NULL AS known, o.id IS NOT NULL AND i.id % 3 = 0 AS own, true AS accepted FROM i LEFT JOIN o ON o.id = i.id), {', '.join(map(_round, range(ROUNDS)))}, "
       f"x AS (SELECT f.*, k.own AS mine FROM s{ROUNDS} f LEFT JOIN s{ROUNDS} k ON k.id = f.kept AND f.hash = k.hash), m AS (SELECT kept, min(id) AS first_id FROM x WHERE mine GROUP BY 1), d AS (SELECT doi, min(id) AS did FROM x WHERE accepted AND doi IS NOT NULL GROUP BY 1) "
       "SELECT x.id, CASE WHEN accepted THEN 'imported' WHEN mine AND first_id = x.id THEN 'again' WHEN did < x.id THEN 'doi' ELSE 'hash' END AS outcome, coalesce(x.kept, x.id) AS kept FROM x LEFT JOIN m ON m.kept = x.kept LEFT JOIN d ON d.doi = x.doi WHERE NOT known")
def import_outcomes(c):
    """An import with all rules, into a project that has the first documents."""
    rows = M.identities(c.spark.sql(RECORDS, document=c.view("document")))
    old = rows.orderBy("id").limit(OLD).withColumn("own", F.col("id") % 3 == 0)
    return M.import_outcomes(rows.join(old.select("id"), "id", "left_anti"), old)


@query("""WITH n AS (SELECT l_orderkey AS document_id, l_linenumber AS position, concat('Writer ', CAST(l_suppkey % 900 AS STRING)) AS name FROM {lineitem}), k AS (SELECT s_suppkey AS id, lower(concat('writer ', CAST(s_suppkey AS STRING))) AS normalized FROM {supplier} WHERE s_suppkey < 400),
 f AS (SELECT lower(name) AS normalized, min(struct_pack(document_id := document_id, position := position, name := name)) AS first FROM n GROUP BY 1), j AS (SELECT f.normalized, first.name AS name, first.document_id AS document_id, first.position AS position, k.id FROM f LEFT JOIN k ON k.normalized = f.normalized), t AS (SELECT coalesce(max(id), 0) AS top FROM k)
 SELECT coalesce(id, top + row_number() OVER (PARTITION BY id IS NULL ORDER BY document_id, position, normalized)) AS id, id IS NULL AS is_new, normalized, name FROM j, t""")
def resolve_import(c):
    """Names of an import against known identities; unknown ones get new ids in order of appearance, at one place by form."""
    rows = c.source("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Writer "), (F.col("l_suppkey") % 900).cast("string")).alias("name")).withColumn("normalized", F.lower("name"))
    known = c.source("supplier").where("s_suppkey < 400").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("writer "), F.col("s_suppkey").cast("string")).alias("normalized"))
    return M.resolve(rows, known, ["normalized"]).select("id", "is_new", "normalized", "name")


@query("""WITH g AS (SELECT document_id FROM {da} WHERE document_id % 7 = 0 GROUP BY 1), n AS (SELECT document_id, min(author) AS author FROM {da} WHERE document_id % 14 = 0 GROUP BY 1)
 SELECT document_id, author FROM {da} WHERE document_id NOT IN (SELECT document_id FROM g) UNION ALL SELECT document_id, author FROM n""")
def replaced_links(c):
    """Author links after every seventh document was enriched anew: half of these keep one author, the others none."""
    links = c.document_authors
    some = links.where("document_id % 7 = 0")
    new = some.where("document_id % 14 = 0").groupBy("document_id").agg(F.min("author").alias("author"))
    return M.replace_links(links, new, some.select("document_id"))


# ---- more of networks, merges, boards ----

SQL["color_board"] = f"""WITH r AS (SELECT id AS group_id, CASE WHEN id % 2 = 0 THEN '#ff0000' ELSE '#4f8ef7' END AS color, CASE WHEN id > 3 THEN concat(id, '. colours') END AS section FROM {values(GROUPS, "id, type, position")} WHERE type = 'normal'),
 d AS (SELECT group_id, count(DISTINCT document_id) AS docs FROM ({ASSIGNED}) GROUP BY 1) SELECT color, section, count(*) AS groups, CAST(coalesce(sum(docs), 0) AS BIGINT) AS docs FROM r LEFT JOIN d ON d.group_id = r.group_id GROUP BY 1, 2"""


@query(KW + """, t AS (SELECT sum(weight) AS t FROM e), i AS (SELECT source % 5 AS c, sum(weight) AS w FROM e WHERE source % 5 = target % 5 GROUP BY 1), d AS (SELECT c, sum(weight) AS w FROM (SELECT source % 5 AS c, weight FROM e UNION ALL SELECT target % 5, weight FROM e) GROUP BY 1)
 SELECT round(sum(coalesce(i.w, 0) / t - pow(d.w / (2 * t), 2)), 9) AS modularity FROM d LEFT JOIN i ON i.c = d.c, t""")
def modularity(c):
    """Of clusters fixed by the ids."""
    return N.modularity_of(_kw(c)[1].withColumn("a", F.col("source") % 5).withColumn("b", F.col("target") % 5))


@query("""WITH p AS (SELECT trim(country) AS country, count(DISTINCT document_id) AS doc_count FROM {dc} GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY doc_count DESC, country) AS INT) AS id, country, doc_count FROM p""")
def net_country_nodes(c):
    return N.country_nodes(c.document_countries)


@query("""WITH d AS (SELECT id, year, cited_by, source_title, issn, doi FROM {doc}), k AS (SELECT doi, min(id) AS kept FROM d WHERE doi IS NOT NULL GROUP BY 1), p AS (SELECT kept, id AS dropped FROM d JOIN k USING (doi) WHERE id <> kept),
 g AS (SELECT kept, max(cited_by) AS c, arg_min(year, id) FILTER (year IS NOT NULL) AS y, arg_min(source_title, id) FILTER (source_title IS NOT NULL) AS s, arg_min(issn, id) FILTER (issn IS NOT NULL) AS i FROM p JOIN d ON d.id = dropped GROUP BY 1)
 SELECT d.id, coalesce(year, y) AS year, greatest(cited_by, c) AS cited_by, coalesce(source_title, s) AS source_title, coalesce(issn, i) AS issn FROM d LEFT JOIN g ON g.kept = d.id WHERE d.id NOT IN (SELECT dropped FROM p)""")
def merged_documents(c):
    """Documents of one DOI merged into the first."""
    docs = c.documents
    first = docs.where("doi IS NOT NULL").groupBy("doi").agg(F.min("id").alias("kept"))
    pairs = docs.join(first, "doi").where("id <> kept").select("kept", F.col("id").alias("dropped"))
    return M.merge_documents(docs.select("id", "year", "cited_by", "source_title", "issn"), pairs)


@query("""WITH m AS (SELECT *, entity_type = 'author' AND scope = 'project' AND scope_id = 2 AS here FROM {authority_mapping}), f AS (SELECT coalesce(max(target_id), 9) AS final FROM m WHERE here AND source_id = 9)
 SELECT entity_type, scope, scope_id, source_id, CASE WHEN here AND target_id = 10 THEN final ELSE target_id END AS target_id FROM m, f WHERE NOT (here AND source_id = 10) UNION ALL SELECT 'author', 'project', 2, 10, final FROM f""")
def merged_mapping(c):
    """The mappings after author 10 was grouped into author 9, who is grouped already."""
    return D.merge_mapping(c.view("authority_mapping"), "author", "project", 2, 10, 9)


# ---- readers: the corpus written in the formats of the sources and read again ----


def _export(c: Corpus) -> DataFrame:
    """id, year, cited_by, source_title, title and authors (joined by ; ) of documents with authors."""
    names = I.author_string(c.author_links, c.view("author"))
    rows = c.documents.select(F.col("id").alias("document_id"), "year", "cited_by", F.nullif("source_title", F.lit("")).alias("source_title"))
    return c.kept("export", lambda: rows.join(c.titles, "document_id").join(names, "document_id").withColumn("key", F.col("document_id").cast("string")))


def _read(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("external_id", "title", "year", "source_title", F.array_join("author_names", "; ").alias("authors"), *more)


EXPORTED = "SELECT CAST(d.id AS VARCHAR) AS external_id, title, year, nullif(source_title, '') AS source_title, s.authors FROM ({0}) d JOIN ({1}) t ON t.document_id = d.id JOIN ({2}) s ON s.document_id = d.id".format(
    oracle("SELECT id, year, cited_by, source_title FROM {doc}"), oracle("SELECT * FROM {title}"), AUTHOR_STRING
)
EXPORTED_CITED = EXPORTED.replace(", s.authors FROM", ", s.authors, cited_by FROM", 1)


def _tag(tag: str, c: Column) -> Column:
    """A line of tagged text, or nothing where the value is null."""
    return F.concat(F.lit(tag), c.cast("string"))


def _each(tag: str) -> Column:
    return F.array_join(F.transform(F.split("authors", "; "), lambda x: F.concat(F.lit(tag), x)), "\n")


@query(EXPORTED)
def read_ris(c):
    col = F.col
    lines = F.concat_ws("\n", F.lit("TY  - JOUR"), _tag("ID  - ", col("key")), _tag("TI  - ", col("title")), _each("AU  - "), _tag("PY  - ", col("year")), _tag("JO  - ", col("source_title")), F.lit("ER  - "))
    return _read(R.read_ris(c.spark, c.exported("ris", _export(c).select(lines).write.text)))


@query(EXPORTED)
def read_nbib(c):
    col = F.col
    lines = F.concat_ws("\n", _tag("PMID- ", col("key")), _tag("TI  - ", col("title")), _each("FAU - "), _tag("DP  - ", col("year")), _tag("JT  - ", col("source_title")), F.lit(""))
    return _read(R.read_nbib(c.spark, c.exported("nbib", _export(c).select(lines).write.text)))


@query(EXPORTED_CITED)
def read_wos(c):
    col = F.col
    lines = F.concat_ws("\n", F.lit("PT J"), F.concat(F.lit("AU "), F.regexp_replace("authors", "; ", "\n   ")), _tag("TI ", col("title")), _tag("SO ", col("source_title")), _tag("PY ", col("year")), _tag("TC ", col("cited_by")), _tag("UT ", col("key")), F.lit("ER\n"))
    return _read(R.read_wos(c.spark, c.exported("wos", _export(c).select(lines).write.text)), "cited_by")


@query(EXPORTED_CITED)
def read_scopus(c):
    rows = _export(c).select(F.col("authors").alias("Authors"), F.col("title").alias("Title"), F.col("year").alias("Year"), F.col("source_title").alias("Source title"), F.col("cited_by").alias("Cited by"), F.col("key").alias("EID"))
    return _read(R.read_scopus_csv(c.spark, c.exported("scopus", lambda at: rows.write.csv(at, header=True, quote='"', escape='"'))), "cited_by")


@query(EXPORTED_CITED)
def read_lens(c):
    rows = _export(c).select(F.col("key").alias("Lens ID"), F.col("title").alias("Title"), F.col("year").alias("Publication Year"), F.col("authors").alias("Author/s"), F.col("source_title").alias("Source Title"), F.col("cited_by").alias("Citing Works Count"))
    return _read(R.read_lens_csv(c.spark, c.exported("lens", lambda at: rows.write.csv(at, header=True, quote='"', escape='"'))), "cited_by")


@query(EXPORTED_CITED)
def read_works(c):
    """As JSON lines; the ids get a W as works have it."""
    people = F.transform(F.split("authors", "; "), lambda x: F.struct(F.struct(x.alias("display_name")).alias("author")))
    place = F.struct(F.struct(F.col("source_title").alias("display_name")).alias("source"))
    rows = _export(c).select(F.concat(F.lit("https://openalex.org/W"), "key").alias("id"), "title", F.col("year").alias("publication_year"), F.col("cited_by").alias("cited_by_count"), place.alias("primary_location"), people.alias("authorships"))
    got = _read(R.read_works_json(c.spark, c.exported("works", rows.write.json)), "cited_by")
    return got.withColumn("external_id", F.substring("external_id", 2, 20))


# ---- upkeep of identities ----


@query("SELECT * FROM {authority_mapping} WHERE NOT (entity_type = 'author' AND scope = 'project' AND scope_id = 2 AND source_id = 13)")
def undone_mapping(c):
    return D.undo_mapping(c.view("authority_mapping"), "author", "project", 2, 13)


@query("""WITH l AS (SELECT DISTINCT e.*, CASE e.document_id % 10 WHEN 0 THEN author + 1 WHEN 1 THEN NULL ELSE author END AS stored FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id)
 SELECT document_id, author_id, position, author, stored FROM l WHERE author IS DISTINCT FROM stored""")
def diverging_links(c):
    """Links whose stored author is another one, or none."""
    links, at = c.author_links.distinct(), F.col("document_id") % 10
    stored = links.withColumn("author", F.when(at == 0, F.col("author") + 1).when(at == 1, None).otherwise(F.col("author")))
    return D.diverging_links(links, stored, ["document_id", "author_id", "position"], "author")


@query("""WITH d AS (SELECT author AS id, count(DISTINCT document_id) AS n FROM {da} GROUP BY 1)
 SELECT a.id, preferred_name AS name, coalesce(n, 0) AS documents FROM {author} a LEFT JOIN d ON d.id = a.id WHERE (lower(preferred_name) LIKE '%12%' OR concat('v', a.id % 130) LIKE '%12%') AND a.id NOT IN (SELECT source_id FROM {authority_mapping} WHERE entity_type = 'author' AND scope = 'project')""")
def author_list(c):
    """Authors whose name or variation holds a text, without those that are grouped."""
    a = c.view("author").select("id", F.col("preferred_name").alias("name"), F.lower("preferred_name").alias("normalized"))
    other = c.view("author").select("id", F.concat(F.lit("V"), (F.col("id") % 130).cast("string")).alias("variation"))
    grouped = c.view("authority_mapping").where("entity_type = 'author' AND scope = 'project'").select("source_id")
    return D.entity_list(a, other, c.document_authors.withColumnRenamed("author", "id"), "12", grouped)


@query("""WITH i AS (SELECT concat('e', s_suppkey % 40) AS normalized, min(s_suppkey) AS id FROM {supplier} GROUP BY 1), r AS (SELECT DISTINCT concat('e', s_suppkey % 40) AS header, concat('e', (s_suppkey + 1) % 60) AS variation FROM {supplier})
 SELECT min(h.id) AS kept, v.id AS dropped FROM r JOIN i h ON h.normalized = header JOIN i v ON v.normalized = variation WHERE h.id <> v.id GROUP BY v.id""")
def table_merges(c):
    """The pairs that a merge table gives; unknown names and an entity with itself give none."""
    own = c.source("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("e"), (F.col("s_suppkey") % 40).cast("string")).alias("normalized"))
    entries = c.source("supplier").select(F.concat(F.lit("e"), (F.col("s_suppkey") % 40).cast("string")).alias("header"), F.array(F.concat(F.lit("e"), ((F.col("s_suppkey") + 1) % 60).cast("string"))).alias("variations"))
    return D.merges_of_table(own, entries)[0]


@query("SELECT DISTINCT document_id, CASE WHEN institution_id BETWEEN 10 AND 19 THEN institution_id - 10 ELSE institution_id END AS institution_id FROM {document_institution} l JOIN {doc} d ON d.id = l.document_id")
def merged_institutions(c):
    """Links after ten institutions went into others."""
    pairs = c.view("institution").where("id BETWEEN 10 AND 19").select((F.col("id") - 10).alias("kept"), F.col("id").alias("dropped"))
    return E.merge_entity(c.document_institutions, "institution_id", pairs)


@query("SELECT l_orderkey AS document_id, CASE WHEN l_suppkey % 20 = 7 AND l_linenumber = 2 THEN 999999 ELSE l_suppkey % 20 END AS author_id, concat('N', CAST(l_linenumber AS VARCHAR)) AS original_name FROM {lineitem}")
def separated_author(c):
    """Links after one written form of an author got an identity of its own."""
    links = c.source("lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 20).alias("author_id"), F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("original_name"))
    return D.separate_variation(links, 7, "N2", 999999)


from marginalia.plans import reports  # noqa: E402, F401  registers more queries
