"""Registered queries over stored tables, bulk groupings, comparisons of groups and what is unresolved."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import classify as C
from marginalia.operators import comparison as P
from marginalia.operators import importing as M
from marginalia.operators import indicators as I
from marginalia.operators import networks as N
from marginalia.operators import upkeep as U
from marginalia.operators.identity import effective_authors
from marginalia.plans import catalog as Q
from marginalia.plans.catalog import query
from marginalia.plans.corpus import Corpus
from marginalia.sources.store import store_folder, stored
from marginalia.sources.versions import VersionedTable
from marginalia.streaming import ingest as G


def _table(c: Corpus, rows: DataFrame, keys: list[str], buckets: int = 8) -> VersionedTable:
    return VersionedTable.create(rows, f"{store_folder(c.spark)}/table-{uuid.uuid4().hex}", keys, buckets)


# ---- versions ----


@query(Q.SQL["lotka"])
def kept_lotka(c):
    """Made once for a version of the data and then read, by any session."""
    of = lambda: c.results.get(c.project_id, "lotka", {"table": "document_authors"}, lambda: I.lotka(c.document_authors))
    of()
    return of()


CHANGES = "SELECT id, year, CASE WHEN id % 7 = 0 THEN coalesce(cited_by, 0) + 1 ELSE cited_by END AS cited_by FROM {doc} WHERE id % 7 = 0 AND id % 5 < 3"


@query(f"""WITH n AS ({CHANGES}), g AS (SELECT id FROM {{doc}} WHERE id % 11 = 5) SELECT id, year, cited_by FROM {{doc}} WHERE id NOT IN (SELECT id FROM n) AND id NOT IN (SELECT id FROM g)
 UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT -id, year, 0 FROM {{doc}} WHERE id % 100 = 1""")
def stored_documents(c):
    """A stored table after an upsert of changed and new documents and a deletion: three versions."""
    docs = c.documents.select("id", "year", "cited_by")
    table = _table(c, docs, ["id"])
    more = docs.where("id % 100 = 1").select((-F.col("id")).alias("id"), "year", F.lit(0).alias("cited_by"))
    table.upsert(docs.where("id % 7 = 0 AND id % 5 < 3").withColumn("cited_by", F.coalesce("cited_by", F.lit(0)) + 1).unionByName(more), F.col("cited_by"))
    table.delete(docs.where("id % 11 = 5").select("id"))
    return table.read()


@query("""WITH g AS (SELECT DISTINCT document_id FROM {da} WHERE document_id % 9 = 4) SELECT * FROM {da} WHERE document_id NOT IN (SELECT document_id FROM g)
 UNION ALL SELECT document_id, 1000000 + document_id % 10 FROM g WHERE document_id % 2 = 0""")
def stored_links(c):
    """The links of some documents replaced in a stored table; documents without new ones lose theirs."""
    table = _table(c, c.document_authors, ["document_id"])
    own = c.document_authors.where("document_id % 9 = 4").select("document_id").distinct()
    table.replace(own, own.where("document_id % 2 = 0").select("document_id", (F.col("document_id") % 10 + 1_000_000).alias("author")))
    return table.read()


REMAPPED = """SELECT entity_type, scope, scope_id, source_id, CASE WHEN scope = 'global' AND source_id % 20 = 9 THEN target_id - 1 ELSE target_id END AS target_id FROM {authority_mapping} WHERE NOT (scope = 'user' AND source_id % 60 = 5)
 UNION ALL SELECT 'author', 'project', 2, s_suppkey, 1 FROM {supplier} WHERE s_suppkey % 40 = 22"""


@query(f"""WITH m AS ({REMAPPED}) SELECT l.document_id, l.author_id, l.position, coalesce(p.target_id, u.target_id, g.target_id, l.author_id) AS author FROM {{document_author}} l JOIN {{doc}} d ON d.id = l.document_id JOIN {{project}} j ON j.id = d.project_id
 LEFT JOIN m p ON p.entity_type = 'author' AND p.scope = 'project' AND p.scope_id = d.project_id AND p.source_id = l.author_id LEFT JOIN m u ON u.entity_type = 'author' AND u.scope = 'user' AND u.scope_id = j.owner_id AND u.source_id = l.author_id
 LEFT JOIN m g ON g.entity_type = 'author' AND g.scope = 'global' AND g.source_id = l.author_id""")
def refreshed_authors(c):
    """Stored effective authors after mappings came, went and moved: the buckets of these alone are read and written."""
    before = c.view("authority_mapping")
    after = before.where("NOT (scope = 'user' AND source_id % 60 = 5)").withColumn("target_id", F.when(F.expr("scope = 'global' AND source_id % 20 = 9"), F.col("target_id") - 1).otherwise(F.col("target_id")))
    new = c.source("supplier").where("s_suppkey % 40 = 22").select(F.lit("author").alias("entity_type"), F.lit("project").alias("scope"), F.lit(2).alias("scope_id"), F.col("s_suppkey").alias("source_id"), F.lit(1).alias("target_id"))
    after = stored(after.unionByName(new), "mapping")
    table = _table(c, c.author_links, ["author_id"], 32)
    U.refresh_effective(table, U.changed_sources(before, after, "author"), lambda rows: effective_authors(rows, c.documents, c.view("project"), after), "author")
    return table.read()


# ---- groupings in bulk ----


def _one_by_one(merges: str) -> str:
    """SQL: the global author mapping after merges(nr, source_id, target_id) done one by one: run(nr, src, dst, outcome, target_id)."""
    return f"""m AS (SELECT row_number() OVER (ORDER BY nr) AS i, * FROM ({merges})), b0 AS (SELECT source_id, target_id FROM {{authority_mapping}} WHERE entity_type = 'author' AND scope = 'global'),
 run(i, nr, src, dst, outcome, target_id) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), list(source_id ORDER BY source_id), list(target_id ORDER BY source_id), '', CAST(NULL AS BIGINT) FROM b0
  UNION ALL SELECT i + 1, nr, CASE WHEN outcome = 'merged' THEN list_append(src, b) ELSE src END, CASE WHEN outcome = 'merged' THEN list_append(list_transform(dst, lambda x: CASE WHEN x = b THEN f ELSE x END), f) ELSE dst END, outcome, f
  FROM (SELECT q.i, q.nr, b, f, src, dst, CASE WHEN a = b THEN 'self' WHEN f = b THEN 'loop' WHEN own = f THEN 'noop' WHEN own IS NOT NULL THEN 'elsewhere' ELSE 'merged' END AS outcome
   FROM (SELECT run.i, m.nr, m.source_id AS b, m.target_id AS a, src, dst, coalesce(dst[list_position(src, m.target_id)], m.target_id) AS f, dst[list_position(src, m.source_id)] AS own FROM run JOIN m ON m.i = run.i + 1) q))"""


MERGES = "SELECT s_suppkey * 3 + k AS nr, s_suppkey AS source_id, (s_suppkey * (7 + k) + 11 * k) % (SELECT count(*) FROM {supplier}) + 1 AS target_id FROM {supplier}, (SELECT unnest([0, 1, 2]) AS k)"


def _merges(c: Corpus) -> DataFrame:
    n = c.source("supplier").count()
    rows = c.source("supplier").select(F.col("s_suppkey").alias("source_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return rows.select((F.col("source_id") * 3 + F.col("k")).alias("nr"), "source_id", ((F.col("source_id") * (F.col("k") + 7) + F.col("k") * 11) % n + 1).alias("target_id"))


@query("WITH RECURSIVE " + _one_by_one(MERGES) + " SELECT CAST(nr AS BIGINT) AS nr, outcome, CAST(target_id AS BIGINT) AS target_id FROM run WHERE i > 0")
def bulk_merge_outcomes(c):
    return U.merge_all(c.view("authority_mapping"), _merges(c), "author", "global", 0)[1]


LAST = " SELECT 'author' AS entity_type, 'global' AS scope, 0 AS scope_id, unnest(src) AS source_id, unnest(dst) AS target_id FROM run WHERE i = (SELECT max(i) FROM run)"


@query("WITH RECURSIVE " + _one_by_one(MERGES) + LAST)
def bulk_merges(c):
    return U.merge_all(c.view("authority_mapping"), _merges(c), "author", "global", 0)[0].where("entity_type = 'author' AND scope = 'global'")


FORMS = "SELECT lower(s_name) AS form, s_suppkey AS id FROM {supplier} UNION ALL SELECT 'form ' || CAST(s_suppkey % 23 AS VARCHAR), s_suppkey FROM {supplier} WHERE s_suppkey % 3 = 0"
WRITTEN = "SELECT e.document_id, e.position, e.author_id AS id, CASE WHEN e.position = 2 THEN 'form ' || CAST((e.author_id + e.document_id) % 40 AS VARCHAR) ELSE lower(a.preferred_name) END AS form FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id JOIN {author} a ON a.id = e.author_id WHERE e.author_id % 4 = 1"


@query("WITH RECURSIVE " + _one_by_one(f"""SELECT document_id * 100000 + position AS nr, id AS source_id, target_id FROM (SELECT w.document_id, w.position, w.id, f.target_id, row_number() OVER (PARTITION BY w.id ORDER BY w.document_id, w.position, f.target_id) AS rn
 FROM ({WRITTEN}) w JOIN (SELECT form, min(id) AS target_id FROM ({FORMS}) GROUP BY 1) f USING (form) WHERE w.id <> f.target_id) WHERE rn = 1""") + LAST)
def remapped_authors(c):
    """Authors whose written forms are another one's are grouped there, by the first link that says so."""
    s = c.source("supplier")
    forms = s.select(F.lower("s_name").alias("form"), F.col("s_suppkey").alias("id")).union(s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("form "), (F.col("s_suppkey") % 23).cast("string")), "s_suppkey"))
    written = F.when(F.col("position") == 2, F.concat(F.lit("form "), ((F.col("author_id") + F.col("document_id")) % 40).cast("string"))).otherwise(F.lower("preferred_name"))
    links = c.author_links.where("author_id % 4 = 1").join(c.view("author").withColumnRenamed("id", "author_id"), "author_id").select("document_id", "position", F.col("author_id").alias("id"), written.alias("form"))
    return U.merge_all(c.view("authority_mapping"), P.variation_merges(links, forms), "author", "global", 0)[0].where("entity_type = 'author' AND scope = 'global'")


# ---- streams ----


@query(Q.SQL["import_outcomes"])
def streamed_import(c):
    """The same import in four batches; each reads the state of its own hashes and titles alone."""
    rows = stored(M.identities(c.spark.sql(Q.RECORDS, document=c.view("document"))), "identities")
    old = rows.orderBy("id").limit(Q.OLD).withColumn("own", F.col("id") % 3 == 0)
    rest = rows.join(old.select("id"), "id", "left_anti")
    state = G.ImportState(c.spark, f"{store_folder(c.spark)}/import-{uuid.uuid4().hex}", old, 8)
    first, last = rest.agg(F.min("id"), F.max("id")).first()
    cuts = [first + (last + 1 - first) * x // 20 for x in (0, 1, 7, 8, 20)] if first is not None else []
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        state.step(rest.where(F.col("id").between(a, b - 1)), batch)
    return state.outcomes(c.spark)


@query("""SELECT event_type, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(c):
    return G.event_counts(c.source("events")).select("event_type", F.unix_seconds("start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
 SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def event_sessions(c):
    return G.event_sessions(c.source("events")).select("user_id", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


# ---- communities of any size ----

LABEL_ROUNDS = 3


def _labels(k: int) -> str:
    """SQL of one round of label_rounds: from l{k} to l{k + 1}."""
    return f"""m{k} AS (SELECT x.id, l.label, sum(x.w) AS w, o.label AS own FROM x JOIN l{k} l ON l.id = x.peer JOIN l{k} o ON o.id = x.id GROUP BY 1, 2, 4),
 l{k + 1} AS (SELECT id, arg_max(label, struct_pack(w := w, stays := label = own, least := -label)) AS label FROM m{k} GROUP BY 1)"""


@query("""WITH e AS (SELECT a.author AS source, b.author AS target, count(*) AS w FROM {da} a JOIN {da} b ON a.document_id = b.document_id AND a.author < b.author GROUP BY 1, 2),
 x AS (SELECT source AS peer, target AS id, w FROM e UNION ALL SELECT target, source, w FROM e), l0 AS (SELECT DISTINCT id, id AS label FROM x), """ + ", ".join(map(_labels, range(LABEL_ROUNDS))) + f" SELECT * FROM l{LABEL_ROUNDS}")
def net_labels(c):
    """Label propagation over all authors of the project."""
    a, b = c.document_authors.toDF("document_id", "source"), c.document_authors.toDF("document_id", "target")
    edges = a.join(b, "document_id").where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return N.label_rounds(edges, rounds=LABEL_ROUNDS)


# ---- comparison of groups ----


def _profiles(c: Corpus) -> DataFrame:
    return c.kept("profiles", lambda: P.group_profiles(
        Q._assigned(c), c.documents.withColumnRenamed("qualis", "stratum"), c.document_institutions, c.view("institution").select("id", F.col("official_name").alias("name"), "nature", "country_id"), c.view("country"),
    ))


PLACES = Q.CLASSIFY + """, p AS (SELECT DISTINCT group_id, cl.document_id, i.official_name AS institution, coalesce(i.nature, 'not given') AS nature, coalesce(c.name, 'not given') AS country, coalesce(c.continent, 'not given') AS continent
 FROM cl JOIN {document_institution} l ON l.document_id = cl.document_id JOIN {institution} i ON i.id = l.institution_id LEFT JOIN {country} c ON c.id = i.country_id WHERE group_id IS NOT NULL)"""


def _counted(kind: str, *more: str) -> str:
    return f"SELECT group_id, '{kind}' AS kind, {kind} AS label, count(*) AS doc_count FROM (SELECT DISTINCT {', '.join(('group_id', 'document_id', kind, *more))} FROM p) GROUP BY 1, 3"


@query("WITH " + PLACES + f" {_counted('country', 'continent')} UNION ALL {_counted('continent')}")
def cmp_geography(c):
    return _profiles(c).where("kind IN ('country', 'continent')")


@query("WITH " + PLACES + f" {_counted('institution', 'nature')} UNION ALL {_counted('nature')}")
def cmp_institutions(c):
    return _profiles(c).where("kind IN ('institution', 'nature')")


@query("WITH " + Q.CLASSIFY + """, p AS (SELECT DISTINCT group_id, document_id, coalesce(nullif(qualis, ''), 'none') AS stratum, CAST(d.year AS VARCHAR) AS year FROM cl JOIN {doc} d ON d.id = document_id WHERE group_id IS NOT NULL)
 """ + f"{_counted('stratum')} UNION ALL SELECT * FROM ({_counted('year')}) WHERE CAST(label AS INT) > 1900 UNION ALL SELECT group_id, 'group', NULL, count(*) FROM p GROUP BY 1")
def cmp_strata(c):
    """Per stratum and year, and each group's total."""
    return _profiles(c).where("kind IN ('stratum', 'year', 'group')")


COUNTS = """ SELECT 'total' AS kind, CAST(NULL AS INT) AS group_id, count(DISTINCT document_id) AS n FROM cl UNION ALL SELECT 'noise', NULL, count(DISTINCT document_id) FROM cl WHERE group_id = 2
 UNION ALL SELECT 'unclassified', NULL, count(*) FROM cl WHERE group_id IS NULL UNION ALL SELECT 'multi', NULL, count(*) FROM (SELECT document_id FROM cl WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'by_group', group_id, count(*) FROM cl GROUP BY group_id"""


@query("WITH " + Q.CLASSIFY + COUNTS + " UNION ALL SELECT 'rejected_unassigned', NULL, 0")
def classify_counts(c):
    return C.classification_counts(C.classify_whole(Q.texts(c), Q.groups(c), Q.rules(c)))


@query("WITH " + Q.CLASSIFY + """, e AS (SELECT document_id, coalesce(year <> 0 AND year < 1996, false) OR document_id NOT IN (SELECT document_id FROM h WHERE group_id = 1) AS gone FROM t),
 w AS (SELECT e.document_id, h.group_id, gone FROM e LEFT JOIN h ON h.document_id = e.document_id AND h.group_id > 2 AND NOT gone)
 SELECT 'total' AS kind, CAST(NULL AS INT) AS group_id, count(DISTINCT document_id) AS n FROM w UNION ALL SELECT 'noise', NULL, 0 UNION ALL SELECT 'unclassified', NULL, count(*) FROM w WHERE group_id IS NULL
 UNION ALL SELECT 'multi', NULL, count(*) FROM (SELECT document_id FROM w WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'by_group', group_id, count(*) FROM w GROUP BY group_id UNION ALL SELECT 'rejected_unassigned', NULL, count(*) FROM w WHERE gone""")
def classify_rejected(c):
    """The same without a group for noise: what would be noise is rejected and has no group."""
    return C.classification_counts(C.classify_whole(Q.texts(c), Q.groups(c).where("id <> 2"), Q.rules(c).where("group_id <> 2")))


# ---- what is not resolved ----


def _resolution(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Equal links are counted before they are looked up: ids, titles and raw names are few, links are not."""
    known = lambda id_, n: id_ % n > 0
    counted = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("n"))
    authors = c.author_links.select("document_id", (F.col("document_id") * 10 + F.col("position")).alias("link_id"), F.col("author_id").alias("raw"), F.col("author").alias("effective"))
    authors = counted(P.first_links(authors), "effective").join(c.view("author").select(F.col("id").alias("effective"), F.col("preferred_name").alias("label")), "effective").withColumn("resolved", known(F.col("effective"), 3))
    effective = c.keyword_links.select("document_id", F.col("keyword_id").alias("raw"), F.col("keyword").alias("effective")).distinct()
    words = c.of_project("document_keyword_position").select("document_id", (F.col("document_id") * 10 + F.col("position")).alias("link_id"), F.col("keyword_id").alias("raw")).join(effective, ["document_id", "raw"])
    shown = P.first_links(words).withColumn("id", F.when(F.col("effective") > 0, F.col("effective")).otherwise(F.col("raw")))
    words = counted(shown, "id").join(c.view("keyword").select("id", F.col("display").alias("label")), "id").withColumn("resolved", known(F.col("id"), 7))
    journals = M.journal_strata(counted(c.documents.where("source_title <> ''"), "source_title", "issn"), Q._journals(c))
    journals = journals.select(F.concat("source_title", F.coalesce(F.concat(F.lit(" ["), "issn", F.lit("]")), F.lit(""))).alias("label"), F.col("stratum").isNotNull().alias("resolved"), "n")
    raw = {q: c.kept(f"raw_{name}", lambda q=q: counted(Q._raw(c, q), F.trim("raw").alias("raw"))) for name, q in (("houses", Q.RAW_HOUSES), ("places", Q.RAW_PLACES))}
    each = lambda rows: rows.select(F.lit(None).cast("long").alias("document_id"), "raw")
    named = lambda found, known, rows: found.join(rows, "raw").select(F.col("raw").alias("label"), known.isNotNull().alias("resolved"), "n")
    houses = named(Q._houses(c, each(raw[Q.RAW_HOUSES])), F.col("kind"), raw[Q.RAW_HOUSES])
    places = named(Q._places(c, each(raw[Q.RAW_PLACES])), F.col("country_id"), raw[Q.RAW_PLACES])
    return P.resolution_report({"author": authors, "keyword": words, "journal": journals, "institution": houses, "country": places})


def _first(links: str, raw: str, eff: str) -> str:
    return f"SELECT * FROM ({links}) q WHERE NOT EXISTS (SELECT 1 FROM ({links}) x WHERE x.document_id = q.document_id AND x.{eff} = q.{eff} AND x.{raw} <> q.{raw} AND x.link_id < q.link_id)"


A_LINKS = "SELECT e.document_id, e.document_id * 10 + e.position AS link_id, e.author_id, e.author FROM {eff_author} e JOIN {doc} d ON d.id = e.document_id"
K_LINKS = "SELECT p.document_id, p.document_id * 10 + p.position AS link_id, p.keyword_id, e.keyword FROM {document_keyword_position} p JOIN (SELECT DISTINCT e.document_id, e.keyword_id, e.keyword FROM {eff_keyword} e JOIN {doc} d ON d.id = e.document_id) e ON e.document_id = p.document_id AND e.keyword_id = p.keyword_id"


def _resolution_sql() -> str:
    places = f"SELECT raw, country_id FROM ({Q.SQL['enrich_country']})"
    journals = "SELECT DISTINCT '1000' || CAST(CAST(1000 + floor(sqrt(c_custkey)) AS INT) AS VARCHAR) AS issn FROM customer WHERE CAST(floor(sqrt(c_custkey)) AS INT) % 3 < 2"
    return f"""al AS ({A_LINKS}), kl AS ({K_LINKS}), au AS ({_first("SELECT * FROM al", "author_id", "author")}), ke AS ({_first("SELECT * FROM kl", "keyword_id", "keyword")}), {Q.HOUSES}, pl AS ({places}), jo AS ({journals}),
 links AS (SELECT 'author' AS kind, a.preferred_name AS label, author % 3 > 0 AS resolved FROM au JOIN {{author}} a ON a.id = author
  UNION ALL SELECT 'keyword', k.display, k.id % 7 > 0 FROM ke JOIN {{keyword}} k ON k.id = CASE WHEN ke.keyword > 0 THEN ke.keyword ELSE ke.keyword_id END
  UNION ALL SELECT 'journal', source_title || coalesce(' [' || issn || ']', ''), replace(replace(lower(issn), '-', ''), ' ', '') IN (SELECT issn FROM jo) IS TRUE FROM {{doc}} WHERE source_title <> ''
  UNION ALL SELECT 'institution', raw, kind IS NOT NULL FROM x UNION ALL SELECT 'country', raw, country_id IS NOT NULL FROM pl),
 per AS (SELECT kind, resolved, label, count(*) AS n FROM links GROUP BY ALL)"""


def register() -> None:
    sql = _resolution_sql()

    @query("WITH " + sql + " SELECT kind, resolved, label, n FROM per QUALIFY row_number() OVER (PARTITION BY kind, resolved ORDER BY n DESC, label) <= 100")
    def resolution_report(c):
        """Of authors, keywords, journals, institutions and countries those that are resolved or not, with repeats left out."""
        return _resolution(c)[0]

    @query("WITH " + sql + " SELECT kind, count(*) FILTER (WHERE NOT resolved) AS unresolved, CAST(coalesce(sum(n) FILTER (WHERE NOT resolved), 0) AS BIGINT) AS unresolved_links, CAST(coalesce(sum(n) FILTER (WHERE resolved), 0) AS BIGINT) AS resolved_links FROM per GROUP BY 1")
    def resolution_totals(c):
        return _resolution(c)[1]


register()
