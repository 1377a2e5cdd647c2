"""Golden values of the pure functions, readers on small files, and every query with SQL against DuckDB."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import forms, text as T
from marginalia.operators import classify, enrichment, identity, importing, networks, similarity, treatment
from marginalia.plans import catalog
from marginalia.sources import exports, records, registry, sinks, vocabularies
from marginalia.streaming import ingest
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, con, name):
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted((tuple(map(cell, r)) for r in x), key=repr)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_louvain_and_modularity():
    clique = lambda a: [(a + i, a + j, 1.0) for i in range(4) for j in range(i + 1, 4)]
    edges = [*clique(0), *clique(4), (3, 4, 0.1)]
    assert list(networks.louvain(list(range(8)), edges).values()) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert networks.modularity({1: 0, 2: 0, 3: 1, 4: 1}, [(1, 2, 1.0), (3, 4, 1.0)]) == pytest.approx(0.5)
    assert networks.modularity({1: 0, 2: 0, 3: 0, 4: 0}, [(1, 2, 1.0), (3, 4, 1.0)]) == pytest.approx(0)
    assert len(set(networks.label_propagation(list(range(8)), edges).values())) == 2


def test_theme_metrics(spark):
    e = spark.createDataFrame([(1, 2, 0.3), (2, 3, 0.3), (4, 5, 0.5), (3, 4, 0.1), (1, 5, 0.05)], "source long, target long, strength double")
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "id long, cluster long")
    got = {r.cluster: (r.centrality, r.density) for r in networks.theme_metrics(e, m).collect()}
    assert got == {0: (0.15, 20.0), 1: (0.15, 25.0)}


def test_association(spark):
    nodes = spark.createDataFrame([(1, 53), (2, 46), (3, 0)], "id long, doc_count long")
    edges = spark.createDataFrame([(1, 2, 14), (1, 3, 5)], "source long, target long, weight long")
    got = {r.target: r.strength for r in networks.association(edges, nodes, "id").collect()}
    assert got == {2: pytest.approx(14 / 2438), 3: 0.0}


def test_matrix(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "A"), (3, "G"), (3, "G"), (3, " "), (3, "0")], "document_id long, v string")
    d = networks.dimension(rows, "v")
    got = {(r.row, r.col): r.weight for r in networks.matrix(d, d).collect()}
    assert got == {("A", "B"): 2, ("B", "A"): 2, ("A", "G"): 1, ("G", "A"): 1}


@pytest.mark.parametrize("name, key", [("Silva, JA", "silv|j"), ("Silva J.A.", "silv|j"), ("João Silva", "silv|j"), ("ten Berge, Hein F. M", "tenb|h"), ("Silva", "silv|")])
def test_block_key(name, key):
    assert similarity.author_block_key(name) == key


def test_similar_pairs(spark):
    d = spark.createDataFrame([(1, "!!!!!!!!!!abcd"), (2, "abcd"), (3, "abce"), (4, "ABCD")], "id long, name string")
    got = {(r.id1, r.id2): r.score for r in similarity.similar_pairs(d, F.lit("x"), 0.85).collect()}
    assert got == {(1, 2): 0.98, (1, 4): 0.98, (2, 4): 1.0}
    assert similarity.similar_text("World", "Word") == 4


@pytest.mark.parametrize("raw, clean", [("Artificial Intelligence (AI)", "Artificial Intelligence (AI)"), ("(machine learning)", "machine learning"), ("(AI) and (ML)", "(AI) and (ML)"), ("machine learning)", "machine learning"), ("&amp;lt;b&gt; x  y ;", "x y")])
def test_clean_display(raw, clean):
    assert T.clean_display(raw) == clean and T.clean_display(clean) == clean


def test_text_forms():
    assert T.normalize("Árvore-Binária  (2)") == "arvore binaria 2"
    assert T.looks_like_author("Silva, J.") and not T.looks_like_author("machine learning")
    assert T.cut_bytes("aéé", 4) == "aé"


def test_cells(spark):
    cells = ["=1+1", "+5", "-3,5", "-x", "@a", "\tx", "plain", "'kept", "-1.5"]
    d = spark.createDataFrame([(x,) for x in cells], "c string").withColumn("s", T.safe_cell(F.col("c"))).withColumn("back", T.plain_cell(F.col("s")))
    rows = d.collect()
    assert [r.back for r in rows] == cells and [r.s for r in rows] == ["'=1+1", "+5", "-3,5", "'-x", "'@a", "'\tx", "plain", "'kept", "-1.5"]


def test_identity_changes(spark):
    m = spark.createDataFrame([("author", "project", 2, 5, 4)], "entity_type string, scope string, scope_id int, source_id long, target_id long")
    m = identity.merge_mapping(m, "author", "project", 2, 4, 3)
    assert {(r.source_id, r.target_id) for r in m.collect()} == {(5, 3), (4, 3)}
    with pytest.raises(ValueError):
        identity.merge_mapping(m, "author", "project", 2, 3, 4)
    assert identity.undo_mapping(m, "author", "project", 2, 4).count() == 1


def test_dedup_key(spark):
    from marginalia.operators.indicators import dedup_key

    rows = [(" 10.1/ABC ", False, "s", "1", "t", 2020), (None, False, "s", None, " My  Title Here ", 2020), (None, True, "brapci", "100", "t", 2020)]
    d = spark.createDataFrame(rows, "doi string, strict boolean, source string, ext string, title string, year int")
    got = [r[0] for r in d.select(dedup_key(*(F.col(c) for c in ("doi", "strict", "source", "ext", "title", "year")))).collect()]
    import hashlib

    assert got == [hashlib.md5(x).hexdigest() for x in (b"doi:10.1/abc", b"my title here:2020", b"ext:brapci:100")]


def test_first_of_each_is_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = [(i, f"h{rng.randrange(30)}") for i in range(100)]
    got = {r.id for r in importing.first_of_each(spark.createDataFrame(rows, "id long, hash string"), "hash", "id").where("outcome = 'hash'").collect()}
    seen = set()
    assert got == {i for i, h in rows if h in seen or seen.add(h)}


def fold(rows, known):
    """Outcomes of an import, one record after the other."""
    dois, hashes, titles, met, out = {}, {}, {}, set(), {}

    def accept(r):
        if r.doi:
            dois.setdefault(r.doi, r.id)
        hashes.setdefault(r.hash, r.id)
        if r.title_year:
            titles.setdefault(r.title_year, r)

    own = {r.id for r in known if r.own}
    for r in sorted(known, key=lambda r: r.id):
        accept(r)
    for r in sorted(rows, key=lambda r: r.id):
        match = hashes.get(r.hash)
        first = titles.get(r.title_year) if r.title_year else None
        if match is not None and match in own and match not in met:
            met.add(match)
            out[r.id] = "again", match
        elif match is not None:
            out[r.id] = "doi" if r.doi in dois else "hash", match
        elif first and not (r.doi and first.doi) and (first.source != r.source or first.kind == "title" if r.strict else first.kind == "ext"):
            out[r.id] = "hash", first.id
        else:
            out[r.id] = "imported", r.id
            accept(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_import_outcomes_are_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick(None, None, "", "10.1/" + pick("A", "a", "b", "c") + str(rng.randrange(9))), pick("Alpha", "beta"), pick(None, str(rng.randrange(40))), pick(None, "T " * rng.randint(1, 6), "t"), pick(2000, 2001, None), rng.random() < 0.5) for i in range(400)]
    d = importing.identities(spark.createDataFrame(rows, "id long, doi string, source string, external_id string, title string, year int, strict boolean")).withColumn("own", F.col("id") % 3 == 0)
    d = d.where("hash IS NOT NULL")
    one = d.where("id < 30").groupBy("hash").agg(F.min("id").alias("id"))
    known, new = d.join(one, ["id", "hash"], "left_semi"), d.where("id >= 30")
    got = {r.id: (r.outcome, r.kept) for r in importing.import_outcomes(new, known).collect()}
    assert got == fold(new.collect(), known.collect())
    assert {o for o, _ in got.values()} >= {"imported", "again", "doi", "hash"}
    assert importing.import_outcomes(new.limit(0)).count() == 0


def test_resolve_gives_new_ids_in_order(spark):
    names = spark.createDataFrame([(2, 1, "B", "b"), (1, 2, "c", "c"), (1, 1, "A", "a"), (2, 2, "C", "c")], "document_id long, position int, name string, normalized string")
    known = spark.createDataFrame([(7, "a")], "id long, normalized string")
    got = {r.normalized: (r.id, r.is_new, r.name) for r in importing.resolve(names, known, ["normalized"]).collect()}
    assert got == {"a": (7, False, "A"), "c": (8, True, "c"), "b": (9, True, "B")}


def test_moves_by_hand(spark):
    rows = spark.createDataFrame([(1, 3, "a", False), (1, 6, "b", False), (2, 3, "a", False), (3, None, None, False)], "document_id long, group_id int, term string, manual boolean")
    after = lambda *x: {tuple(r) for r in classify.move(rows, *x).collect()}
    every = {tuple(r) for r in rows.collect()}
    assert after(1, 3, 6) == every - {(1, 3, "a", False), (1, 6, "b", False)} | {(1, 6, "b", True)}
    assert after(2, 3, None) == every - {(2, 3, "a", False)} | {(2, None, "a", True)}
    assert after(3, None, 4) == every - {(3, None, None, False)} | {(3, 4, None, True)}
    assert after(9, 3, 4) == every and after(1, 3, 3) == every


def test_decisions_on_open_entries(spark):
    log = spark.createDataFrame([(1, 10, "fuzzy_review_required", "pending", 5), (2, 11, "fuzzy_review_required", "pending", None), (3, 12, "fuzzy_review_required", "applied", 5), (4, 13, "fuzzy_review_required", "pending", 6)], "id long, keyword_id long, action string, status string, concept_id long")
    words = spark.createDataFrame([(i, "w", "w", None) for i in (10, 11, 12, 13)], "id long, display string, normalized string, thesaurus_concept_id long")
    new_log, new_words = treatment.decide(log, words, spark.createDataFrame([(1, "approve", None), (2, "edit", " New Form "), (3, "reject", None), (4, "edit", " ")], "log_id long, decision string, new_display string"))
    assert {r.id: (r.action, r.status) for r in new_log.collect()} == {1: ("manual_approved", "applied"), 2: ("cleaned", "applied"), 3: ("fuzzy_review_required", "applied"), 4: ("fuzzy_review_required", "pending")}
    assert {r.id: (r.display, r.normalized, r.thesaurus_concept_id) for r in new_words.collect()} == {10: ("w", "w", 5), 11: ("New Form", "new form", None), 12: ("w", "w", None), 13: ("w", "w", None)}


def test_thematic_map_of_few_words(spark):
    words = spark.createDataFrame([(d, k) for d in range(4) for k in (1, 2)] + [(d, k) for d in range(4, 8) for k in (3, 4)], "document_id long, keyword long")
    names, docs = spark.createDataFrame([(k, f"k{k}") for k in range(1, 5)], "keyword long, label string"), spark.createDataFrame([(d, 2000 + d) for d in range(8)], "id long, year int")
    got = networks.thematic_map(words, names).collect()
    assert sorted((r.label, r.size, r.doc_count, r.centrality, r.density, r.median_density, r.quadrant) for r in got) == [("k1", 2, 8, 0.0, 12.5, 12.5, "motor"), ("k3", 2, 8, 0.0, 12.5, 12.5, "motor")]
    years = lambda a, b: {r.label for r in networks.thematic_map(words, names, docs=docs, first_year=a, last_year=b).collect()}
    assert years(2000, 2003) == years(2003, 2000) == years(None, 2003) == {"k1"} and years(2004, 9999) == {"k3"} and years(None, None) == {"k1", "k3"}
    none = words.limit(0)
    assert networks.thematic_map(none, names).count() == 0 and networks.thematic_evolution(none, docs, names, 2003).count() == 0
    edges = networks.association(networks.co_edges(none, networks.top_nodes(none, "keyword", 9), "keyword"), networks.top_nodes(none, "keyword", 9), "keyword")
    assert networks.clusters(edges, method="labels").count() == 0


def test_ranks_over_partitions(spark):
    ids = spark.range(1000).where("id % 3 <> 0")
    got = {r.id: r.rank for r in similarity.ranked(ids, "rank").collect()}
    assert got == {i: k + 1 for k, i in enumerate(i for i in range(1000) if i % 3)}


def test_upsert_and_merge(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("b", 8), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in importing.upsert(old, new, ["k"], "v").collect()} == {("a", 1), ("b", 8), ("c", 3)}
    docs = spark.createDataFrame([(1, None, 3), (2, "x", 7), (3, "y", None)], "id long, doi string, cited_by int")
    got = importing.merge_documents(docs, spark.createDataFrame([(1, 2)], "kept long, dropped long"))
    assert {tuple(r) for r in got.collect()} == {(1, "x", 7), (3, "y", None)}


def test_lens_needs_word_bounds(spark):
    docs = spark.createDataFrame([(1, "the factory floor"), (2, "Actor-Network Theory")], "document_id long, text string")
    got = classify.lens_matches(docs, spark.createDataFrame([("a", "actor"), ("b", "actor-network"), ("c", "")], "lens string, term string")).collect()
    assert {(r.lens, r.samples) for r in got} == {("a", "2"), ("b", "2")}


# ---- readers ----

RIS = "TY  - JOUR\nTI  - A title\n that goes on\nAU  - Silva, J.\nAU  - Souza, M.\nPY  - 2019/09/30/\nKW  - x\nKW  - x\nKW  - y\nSN  - 12345678\nDO  - https://doi.org/10.1234/ABC.\nUR  - javascript:alert(1)\nER  - \n\nTY  - BOOK\nTI  - Open\nPY  - 2014///Mar/Apr\n"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_ris(spark, tmp_path, end):
    (tmp_path / "a.ris").write_text("\ufeff" + RIS.replace("\n", end), newline="")
    a, b = sorted(records.read_ris(spark, str(tmp_path)).collect(), key=lambda r: r.title)
    assert (a.title, a.year, a.issn, a.doi, a.url, a.author_keywords) == ("A title that goes on", 2019, "1234-5678", "10.1234/abc", None, ["x", "y"])
    assert (b.title, b.year, b.document_type, b.author_names) == ("Open", 2014, "BOOK", [])


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_records_end_at_line_starts_only(spark, tmp_path, end):
    ris = "TY  - JOUR\nTI  - A LASER  - BASED method\nPY  - 2001\nER  - \nTY  - JOUR\nTI  - No end\nTY  - JOUR\nTI  - Last\nER  - \n"
    (tmp_path / "a.ris").write_text(ris.replace("\n", end), newline="")
    got = records.read_ris(spark, str(tmp_path / "a.ris")).collect()
    assert sorted((r.title, r.year) for r in got) == [("A LASER  - BASED method", 2001), ("Last", None), ("No end", None)]
    (tmp_path / "a.nbib").write_text("PMID- 1\nTI  - See PMID- 99 too\nPMID- 2\nTI  - Other\n".replace("\n", end), newline="")
    assert sorted((r.external_id, r.title) for r in records.read_nbib(spark, str(tmp_path / "a.nbib")).collect()) == [("1", "See PMID- 99 too"), ("2", "Other")]
    (tmp_path / "w.txt").write_text("FN x\nPT J\nTI One\nER\n\nPT J\nTI Two\nER\nEF\n".replace("\n", end), newline="")
    assert sorted(r.title for r in records.read_wos(spark, str(tmp_path / "w.txt")).collect()) == ["One", "Two"]


def test_encodings(spark, tmp_path):
    (tmp_path / "bad.ris").write_bytes(b"TY  - JOUR\nTI  - caf\xe9 au\xff lait\nER  - \n")
    assert records.read_ris(spark, str(tmp_path / "bad.ris")).first().title == "caf\ufffd au\ufffd lait"
    with pytest.raises(ValueError):
        registry.read(spark, str(tmp_path / "bad.ris"))
    (tmp_path / "good.ris").write_text("TY  - JOUR\nTI  - café\nER  - \n")
    assert registry.read(spark, str(tmp_path / "good.ris")).first().title == "café"
    cut = ("é" * 200_000).encode()[:-1]
    assert registry.is_utf8(cut, True) and not registry.is_utf8(cut) and not registry.is_utf8("é".encode("utf-16")) and not registry.is_utf8(b"a\0b")
    (tmp_path / "book.xls").write_bytes(registry.BINARY[0] + b"\xff" * 9)
    registry.check_encoding(spark, str(tmp_path / "book.xls"))


def test_nbib_and_wos(spark, tmp_path):
    (tmp_path / "a.nbib").write_text("\nPMID- 12\nTI  - Long\n      title\nFAU - Silva, Ana\nAU  - Silva A\nDP  - 2020 Jan\nOT  - word*\nMH  - Head*\nAID - 10.1000/x [doi]\nPG  - 1-9\n\nPMID- 13\nTI  - Other\n")
    a, b = sorted(records.read_nbib(spark, str(tmp_path / "a.nbib")).collect(), key=lambda r: r.external_id)
    assert (a.external_id, a.title, a.author_names, a.doi, a.author_keywords, a.indexed_keywords, a.page_end, a.year) == ("12", "Long title", ["Silva, Ana"], "10.1000/x", ["word"], ["Head"], "9", 2020)
    assert b.title == "Other"
    (tmp_path / "w.txt").write_text("FN x\nVR 1.0\nPT J\nAU Silva, J\n   Souza, M\nTI Some\n   title\nDE one; two\nC1 [Silva, J] Univ A, City, Brazil.\n   Inst B, Town, CA 99999 USA.\nPY 2001\nTC 7\nUT W:1\nER\n\nPT J\nTI Second\nER\n\nEF\n")
    a, b = sorted(records.read_wos(spark, str(tmp_path / "w.txt")).collect(), key=lambda r: r.title, reverse=True)
    assert (a.title, a.author_names, a.author_keywords, a.countries, a.institutions, a.cited_by) == ("Some title", ["Silva, J", "Souza, M"], ["one", "two"], ["Brazil", "USA"], ["Univ A", "Inst B"], 7)
    assert b.title == "Second"
    assert [registry.detect(spark, str(tmp_path / f)) for f in ("a.nbib", "w.txt")] == ["nbib", "wos"]


def test_tables_and_json(spark, tmp_path):
    (tmp_path / "s.csv").write_text('\ufeff"Authors","Title","Year","Cited by","Author Keywords","Affiliations","EID"\n"A; B","Two\nlines ""q""","2020","3","x; y; x","Dept, University of C, Town, Brazil; Lab D, Peoples R China","e1"\n')
    r = records.read_scopus_csv(spark, str(tmp_path / "s.csv")).first()
    assert (r.author_names, r.title, r.cited_by, r.author_keywords, r.countries, r.institutions) == (["A", "B"], 'Two\nlines "q"', 3, ["x", "y"], ["Brazil", "China"], ["University of C", "Lab D"])
    (tmp_path / "w.jsonl").write_text('{"id":"W1","title":"T","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":"X"},"countries":["BR"]}]}\n')
    r = records.read_works_json(spark, str(tmp_path / "w.jsonl")).first()
    assert (r.abstract, r.author_names, r.countries, r.institutions) == ("a b a", ["X"], ["BR"], [])
    assert registry.detect(spark, str(tmp_path / "s.csv")) == "scopus"


def test_stream_import_and_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.ris").write_text(RIS)
        ingest.import_stream(ingest.stream_ris(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert ingest.event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_cities_file(spark, tmp_path):
    sinks.write_cities(catalog.queries()["cities_report"](spark, SF), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    lines = file.read_text().split("\n")
    assert lines[0] == ",".join(sinks.CITIES) and len(lines) > 5
    counts = [int(x.split(",")[-2]) for x in lines[1:] if x]
    assert counts == sorted(counts, reverse=True)


def test_matrix_table(spark):
    cells = spark.createDataFrame([("a", "x.1", 2), ("a", "y", 3), ("b", "y", 4)], "row string, col string, weight long")
    got = {tuple(r) for r in sinks.matrix_wide(cells, ["x.1", "y"]).collect()}
    assert got == {("a", 2, 3, 5), ("b", 0, 4, 4), ("Total", 2, 7, 9)}
    assert {tuple(r) for r in sinks.matrix_wide(cells.limit(0), ["y"]).collect()} == {("Total", 0, 0)}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 2000, 2), (1, "a", 2001, 3), (2, "=b", 2001, 1)], "keyword long, label string, year int, doc_count long")
    wide = {r.keyword: r for r in sinks.years_wide(d, [2000, 2001]).collect()}
    assert (wide[1].total, wide[2]["2000"], wide[2].total) == (5, 0, 1)
    sinks.safe_csv(d, str(tmp_path / "c"))
    assert {r.label for r in spark.read.csv(str(tmp_path / "c"), header=True, sep=";").collect()} == {"a", "'=b"}


def write(path, text):
    path.write_text(text)
    return str(path)


def test_thesis_tables(spark, tmp_path):
    head = "Autor(a),Orientadores,Título,Ano de defesa,Instituição de defesa,Sigla da instituição de defesa,País da instituição de defesa,Tipo de documento,Tipos de acesso,Assuntos em português,Assuntos em inglês,Idioma,Resumo em Português,Resumo,Link de acesso\n"
    row = '"2019||Silva, Ana, 1980-||x",,"[pt] Um &amp; dois",2019,Universidade X (UX),UX,Não Informado pela Instituição,masterThesis,openAccess,Redes||redes||[pt] Teoria,Nets,pt_BR,Não Informado pela Instituição,<p>Some</p> text,http://a.b/1||https://doi.org/10.1/x\n'
    path = write(tmp_path / "t.csv", head + row + row)
    a, b = sorted(records_of(spark, path), key=lambda r: r.external_id)
    assert b.external_id == a.external_id + "#2" and a.external_id.startswith("bdtd:") and len(a.external_id) == 45
    assert (a.title, a.author_names, a.year, a.document_type, a.open_access_status, a.language) == ("Um & dois", ["Silva, Ana"], 2019, "Dissertação (mestrado)", "Open Access", "por")
    assert (a.author_keywords, a.institutions, a.countries, a.abstract, a.url) == (["Redes", "Teoria", "Nets"], ["Universidade X"], ["Brasil"], "Some text", "http://a.b/1")
    path = write(tmp_path / "t.ris", "TY  - doctoralThesis\nAU  - 2001-02\nAU  - Souza, Rui\nTI  - Tese\nPY  - 2001\nUR  - http://c.d/; http://e.f/\nER  - \n")
    r = records_of(spark, path)[0]
    assert (r.author_names, r.document_type, r.url, r.countries) == (["Souza, Rui"], "Tese (doutorado)", "http://c.d/", [])


def records_of(spark, path):
    return registry.read(spark, path).collect()


def test_baskets(spark, tmp_path):
    head = '"ID","CLASS","YEAR","PUBLICATION","AUTHORS","TITLE","KEYWORDS","ABSTRACTS","SESSION","LEGEND","URL",\n'
    rows = '"7","Article","2020","R","A B; C D (org.)","X &amp; Y","k; l; k",null,"s","R, v. 3, n. nº 2, 2020","https://doi.org/10.1234/one",\n"8","Article","2020","LIVRO","E","::Sem título::",null,null,"s","R","https://doi.org/10.1234/two",\n"9","Article","20","R","F","T","","","","","https://doi.org/10.1234/TWO",\n"x","Article","2020","R","F","T","","","","","",\n'
    got = {r.external_id: r for r in records_of(spark, write(tmp_path / "b.csv", head + rows))}
    assert set(got) == {"7", "8", "9"} and (got["7"].doi, got["8"].doi, got["9"].doi) == ("10.1234/one", None, None)
    assert (got["7"].author_names, got["7"].title, got["7"].author_keywords, got["7"].volume, got["7"].issue, got["7"].abstract) == (["A B", "C D"], "X & Y", ["k", "l"], "3", "2", None)
    assert (got["8"].title, got["8"].source_title, got["9"].year) == (None, None, None) and got["7"].url.endswith("brapci/7")
    r = records_of(spark, write(tmp_path / "b.ris", f"TY  - JOUR\nTI  - T\nUR  - {exports.BASKET_HANDLE}12\nDB  - X\nER  - \n"))[0]
    assert (r.source, r.external_id, r.title) == ("brapci", "12", "T")


def test_searches(spark, tmp_path):
    head = "﻿title,publicationDate,authors,publisher,plink,longDbName,shortDbName,accessionNumber,abstract,docType,source,subjects,keywords,issn,doi,language,coverDate\n"
    rows = '"A title.",20200315,"X, Y ; Z, W",P,https://a.b/c,L,LIH,123,"<b>ab</b>",Article ; Review,S,s1 ; s2,k1,12345678,10.1000/Z,English ; French,\n"Other...",,,,https://a.b/0123456789abcdef-0123456789abcdef-012,L,,,,,,,,,,German,2001 May\n'
    a, b = sorted(records_of(spark, write(tmp_path / "s.csv", head + rows)), key=lambda r: r.title)
    assert (a.title, a.external_id, a.year, a.author_names, a.document_type, a.language, a.abstract, a.indexed_keywords, a.issn, a.doi) == ("A title", "lih:123", 2020, ["X, Y", "Z, W"], "Article", "eng", "ab", ["s1", "s2"], "1234-5678", "10.1000/z")
    assert (b.title, b.year, b.language, b.source) == ("Other...", 2001, "German", "lista") and b.external_id.startswith("plink:")


def test_works_tables(spark, tmp_path):
    head = "Title,Author,Year,Citation count,Open access,Keyword,Source,Institution,Country,Cites,DOI,ISSN,Work ID,Open Access status\n"
    long = "|".join(f"https://openalex.org/W{i:09d}" for i in range(1000))
    a, b = sorted(records_of(spark, write(tmp_path / "o.csv", head + f"<i>T</i> &amp; U,Ana|B|Rui,2020,5,true,k|k|l,S,I||J,BR,W1|x|W2,https://doi.org/10.1000/A,bad|1234-5678,https://openalex.org/W9,green\nLong,A B,,x,,,,,,{long},,,W8,\n")), key=lambda r: r.title)
    b, a = (a, b) if a.title == "Long" else (b, a)
    assert (a.title, a.author_names, a.cited_by, a.indexed_keywords, a.institutions, a.references, a.issn, a.external_id, a.open_access_status, a.url) == ("T & U", ["Ana", "Rui"], 5, ["k", "l"], ["I", "J"], ["W1", "W2"], "1234-5678", "W9", "Green", "https://doi.org/10.1000/a")
    assert (len(b.references), b.cited_by, b.url) == (999, None, "https://openalex.org/W8")
    with pytest.raises(ValueError):
        records_of(spark, write(tmp_path / "d.csv", "Title,Author,Year,Citation count,Open access\nT,A,2020,1,true\n"))
    r = records_of(spark, write(tmp_path / "o.ris", "TY  - JOUR\nTI  - T\nAU  - A B\nC1  - Dept, University of C, Town, Brazil\nDA  - 2020-01-02\nUR  - https://doi.org/10.1000/a\nER  - \n"))[0]
    assert (r.source, r.document_type, r.affiliations, r.countries, r.institutions) == ("openalex", "jour", ["Dept, University of C, Town, Brazil"], ["Brazil"], ["University of C"])
    r = records_of(spark, write(tmp_path / "o.txt", "FN OpenAlex\nVR 1.0\nPT J\nTI T\nDT Book-Chapter\nCT 4\nVL\nUT https://openalex.org/W5\nER\n\nEF\n"))[0]
    assert (r.source, r.external_id, r.cited_by, r.document_type, r.volume) == ("openalex", "W5", 4, "book-chapter", None)


def test_works_pages(spark, tmp_path):
    work = '{"id":"https://openalex.org/W%d","title":"T%d","referenced_works":["https://openalex.org/W1"],"open_access":{"oa_status":"gold"}}'
    pages = '{"meta":{"count":3},\n"results":[' + work % (1, 1) + ",\n" + work % (2, 2) + ',{"title":"bad"}]}'
    for name, text in {"p.json": pages, "a.json": "[\n" + work % (1, 1) + "," + work % (2, 2) + "]", "l.json": work % (1, 1) + "\n" + work % (2, 2) + "\n"}.items():
        path = write(tmp_path / name, text)
        assert registry.detect(spark, path) == ("works" if name == "l.json" else "works_pages")
        got = sorted(records_of(spark, path), key=lambda r: r.title)
        assert [(r.external_id, r.title, r.references, r.source) for r in got] == [("W1", "T1", ["W1"], "openalex"), ("W2", "T2", ["W1"], "openalex")]


def test_archive(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../x/in.ris", "TY")
    assert registry.unpack(str(tmp_path / "a.zip"), str(tmp_path)) == str(tmp_path / "in.ris")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.exe", "")
    with pytest.raises(ValueError):
        registry.unpack(str(tmp_path / "b.zip"), str(tmp_path))


def test_vocabularies(spark, tmp_path):
    path = write(tmp_path / "a.the", "junk\r\n**#Head One\r\n100 1 ^var a$\r\n100 1 ^var a$\r\nplain$\r\n\r\n**Second\r\n")
    assert {r.header: r.variations for r in vocabularies.read_the(spark, path).collect()} == {"Head One": ["var a", "plain"], "Second": []}
    path = write(tmp_path / "b.the", "**#First\n0 1 ^x$\n")
    assert [tuple(r) for r in vocabularies.read_the(spark, path).collect()] == [("First", ["x"])]
    path = write(tmp_path / "m.csv", "﻿preferred_keyword;variant_keyword\nA;a1\nA;a2\nA;a1\nB;\n")
    assert [tuple(r) for r in vocabularies.read_merge_csv(spark, path).collect()] == [("A", ["a1", "a2"])]
    lines = [r.value for r in vocabularies.the_lines(spark.createDataFrame([("B", "x"), ("A", "Y"), ("A", None)], "header string, variation string")).collect()]
    assert lines == ["**#a", "100 1 ^y$", "**#b", "100 1 ^x$"]
    head = "n;t;c;i;p;terms;f;s;e;q;nat;con;cou;a;u\n"
    path = write(tmp_path / "g.csv", head + "G;odd;;;2;'=x, y;title;1990;;a1;;;;;0\ng;noise;#fff;;1;z;;;;;;;;;1\nH;normal;;;;;;;;;;;;;\n")
    groups, rules = vocabularies.read_groups(spark, path)
    assert {r.name: (r.type, r.position, r.use_thesaurus) for r in groups.collect()} == {"g": ("noise", 1, True), "H": ("normal", 0, True)}
    assert [tuple(r) for r in rules.collect()] == [("g", 0, "z")]


@pytest.mark.parametrize("raw, want", [
    ("machine LEARNING in brazil", (True, None, "machine learning in Brazil", "machine learning in brazil", False, "")), ("dna AI de", (True, None, "DNA AI de", "dna ai de", False, "")), ("[12]", (False, "numeric_reference", "", "", False, "")),
    ("a", (False, "empty_or_too_short", "a", "a", False, "")), ("3.04", (False, "purely_numeric", "3.04", "3 04", False, "")), ("sic sic sic", (False, "repetitive_nonsense", "sic sic sic", "sic sic sic", False, "")),
    ("1234 ab", (False, "numeric_fragment", "1234 ab", "1234 ab", False, "")), ("x" * 201, (False, "too_long", "x" * 201, "x" * 201, False, "")), ("Silva, J.", (True, None, "silva, j", "silva j", True, "looks_like_author")), ("web 2", (True, None, "web 2", "web 2", True, "contains_number")),
])
def test_keyword_forms(raw, want):
    assert forms.keyword_form(raw) == want


def test_author_forms():
    assert forms.author_form("Plato")[4:] == (True, "single_word_author") and forms.author_form("MIT Lab 3")[5] == "contains_number,looks_like_institution" and not forms.author_form("-")[0]


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["data", "of", "the", "networks", "deep", "study", "a", "x"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    titles += ["".join(c for c in t if rng.random() > 0.06) or "q" for t in titles]
    rows = [(i, t, 2000 + i % 2, "10.1/x" if i % 3 else None, i % 5) for i, t in enumerate(titles)]
    d = spark.createDataFrame(rows, "id long, title string, year int, doi string, cited_by int")
    got = {(frozenset((r.keep, r.discard)), r.similarity) for r in similarity.duplicate_documents(d, 0.85, 10**6).collect()}
    a, b = (d.select(*(F.col(c).alias(c + k) for c in ("id", "title", "year"))) for k in "12")
    near = F.abs(F.length("title1") - F.length("title2")) <= F.greatest(F.length("title1"), F.length("title2")) * 0.15 + 1e-9
    want = a.join(b, (F.col("year1") == F.col("year2")) & (F.col("id1") < F.col("id2")) & near).select("id1", "id2", similarity.pair_score(F.col("title1"), F.col("title2"), 0.85).alias("s")).where("s IS NOT NULL").collect()
    assert {(frozenset((r.id1, r.id2))) for r in want} == {k for k, _ in got} and len(want) > 50


def test_similar_authors_against_all_pairs(spark):
    rng = random.Random(7)
    names = [f"Silva{''.join(rng.choice('abc') for _ in range(12))}, A" for _ in range(30)]
    names += ["".join(rng.choice("xyz") if rng.random() < 0.1 and 5 < i < 17 else c for i, c in enumerate(n)) for n in names]
    d = spark.createDataFrame([*enumerate(names), (99, names[0])], "id long, name string")  # 99 has no document
    links = spark.createDataFrame([(i, k) for i in range(60) for k in range(i % 4 + 1)] + [(0, 0)] * 5, "author long, document_id long")
    got = {(r.keep, r.discard): r.similarity for r in similarity.similar_authors(d, links, limit=10**6).collect()}
    a, b = (d.where("id < 99").select(F.col("id").alias(f"id{k}"), F.lower("name").alias(f"n{k}")) for k in "12")
    want = a.join(b, F.col("id1") < F.col("id2")).select("id1", "id2", similarity.pair_score(F.col("n1"), F.col("n2"), 0.85).alias("s")).where("s IS NOT NULL").collect()
    rank = lambda i: (-(i % 4), names[i], i)
    assert {tuple(sorted((r.id1, r.id2), key=rank)) for r in want} == set(got) and any(85 <= s < 94 for s in got.values())


def test_thesaurus_matches(spark):
    keys = spark.createDataFrame([(1, "machine lerning", None), (2, "deep networks", None), (3, "iot", None), (4, "graph", "GRPH"), (5, "exact", None), (6, "color", None), (7, "nothing like it", None), (8, "", None), (9, "information retrieval systems", None)], "id long, normalized string, display string")
    labels = spark.createDataFrame([("exact", "Exact", 10), ("colour", "Colour", 11), ("colors", "Colors", 12), ("information retrieval system", "x", 14), ("information retrieval systemz", "x", 14)], "normalized string, label string, concept_id long")
    concepts = spark.createDataFrame([(13, "machine learning", "Machine learning"), (10, "exact", "Exact")], "id long, normalized string, label string")
    got = {r.id: (r.method, r.concept_id, round(r.score, 2), r.ambiguous) for r in treatment.thesaurus_matches(keys, labels, concepts).collect()}
    assert got == {1: ("fuzzy", 13, 93.75, False), 5: ("exact_label", 10, 100.0, False), 6: ("fuzzy", 11, 83.33, True), 9: ("fuzzy_auto", 14, 96.55, False)}
    known = spark.createDataFrame([(6, 11)], "id long, concept_id long")
    assert {r.id for r in treatment.new_suggestions(treatment.thesaurus_matches(keys, labels, concepts), known).collect()} == {1}


def test_entities_and_relinks(spark):
    links = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "document_id long, institution_id long")
    pairs = spark.createDataFrame([(6, 5)], "kept long, dropped long")
    assert {tuple(r) for r in enrichment.merge_entity(links, "institution_id", pairs).collect()} == {(1, 6), (2, 6)}
    kw = spark.createDataFrame([(1, "a", 3), (2, "b", None), (3, "c", 3), (4, "a", 4)], "id long, normalized string, thesaurus_concept_id long")
    labels = spark.createDataFrame([("a", 3), ("b", 4), ("b", 3)], "normalized string, concept_id long")
    assert {tuple(r) for r in treatment.relinked(kw, labels, spark.createDataFrame([(3,)], "concept_id long")).select("id", "thesaurus_concept_id").collect()} == {(1, 3), (2, 3), (3, None), (4, 4)}


def test_term_expansion(spark):
    make = spark.createDataFrame
    got = treatment.term_expansion(make([(1, 0, " Car "), (1, 1, "bus")], "group_id int, position int, term string"), make([(1, "Auto", "auto"), (1, "car", "car")], "concept_id long, label string, normalized string"), make([(1, "Car", "car"), (2, "Bus", "bus")], "id long, label string, normalized string"), make([(9, "bus", 1), (8, "car", 0)], "id long, normalized string, status int"), make([(9, "Omnibus", 1), (9, "old", 0), (8, "no", 1)], "keyword_id long, variation string, status int"))
    assert [r.term for r in got.orderBy("position").collect()] == ["car", "auto", "bus", "omnibus"]


def test_authors_filter_and_continents(spark):
    assert classify.parse_authors("Silva, J.R., Molin") == ["Silva, J.R.", "Molin"] and classify.parse_authors("Li, Wu") == ["Li", "Wu"] and classify.parse_authors("A, B; C\nD ") == ["A, B", "C", "D"]
    d = spark.createDataFrame([("Europa", ["europa/ásia"]), ("Europa/Ásia", ["europa"])], "w string, c array<string>")
    assert [r[0] for r in d.select(classify.continent_matches(F.col("w"), F.col("c"))).collect()] == [True, False]


def test_classify_fields_filters_and_noise(spark):
    docs = spark.createDataFrame([(1, 2000, "ok red", "blue", ["Silva, J."]), (2, 2000, "red", "", []), (3, None, "ok", "red", None), (4, 0, "ok red", None, ["x"]), (5, 1990, "ok red", "", [])], "document_id long, year int, title string, abstract string, authors array<string>")
    groups = spark.createDataFrame([(1, "validator", 0, None, None), (2, "normal", 2, ["title"], ["silva"]), (3, "normal", 3, ["abstract"], None), (9, "noise", 5, None, None)], "id int, type string, position int, match_fields array<string>, authors array<string>")
    rules = spark.createDataFrame([(1, 0, "ok"), (2, 0, "red"), (3, 0, "red"), (3, 1, "blue")], "group_id int, position int, term string")
    assert {tuple(r) for r in classify.classify(docs, groups, rules).collect()} == {(1, 2, "red"), (1, 3, "blue"), (2, 9, None), (3, 3, "red"), (4, None, None), (5, 9, "year<1996")}
    none = classify.classify(docs, groups.where("id < 9"), rules)
    assert {tuple(r) for r in none.where("document_id IN (2, 5)").collect()} == {(2, None, None), (5, None, None)}


def test_keyword_groupings(spark):
    kw = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 2, None), (4, 4, 7), (5, 4, None)], "id long, keyword_concept_id long, thesaurus_concept_id long")
    none = spark.createDataFrame([], "entity_type string, scope string, scope_id int, source_id long, target_id long, note string")
    concepts = lambda k: {r.id: r.keyword_concept_id for r in k.collect()}
    k, m = identity.merge_keywords(kw, none, 2, 1)
    assert concepts(k) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and m.isEmpty()
    assert concepts(identity.merge_keywords(k, m, 2, 1)[0]) == concepts(k)
    with pytest.raises(ValueError):
        identity.merge_keywords(k, m, 1, 2)
    with pytest.raises(ValueError):
        identity.merge_keywords(k, m, 2, 5)
    k, _ = identity.undo_keywords(k, m, 2, spark.createDataFrame([(3,)], "id long"))
    assert concepts(k) == concepts(kw)
    k, m = identity.merge_keywords(kw, none, 4, 1)
    assert {(r.source_id, r.target_id, r.note) for r in m.collect()} == {(4, 1, None), (5, 1, "via #4")} and concepts(k) == concepts(kw)
    assert identity.undo_keywords(k, m, 4)[1].isEmpty()
    assert {r.target_id for r in identity.merge_keywords(kw, none, 1, 4)[1].collect()} == {-7}


def test_merge_tables_and_lists(spark):
    e = spark.createDataFrame([(1, "A", "a"), (2, "B x", "b x"), (3, "C", "c")], "id long, name string, normalized string")
    pairs, refused = identity.merges_of_table(e, spark.createDataFrame([("a", ["b x", "zz", "a"]), ("q", ["c"])], "header string, variations array<string>"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)] and {(r.variation, r.reason) for r in refused.collect()} == {("zz", "unknown variation"), ("a", "same entity"), ("c", "unknown header")}
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10)], "id long, document_id long")
    variations = spark.createDataFrame([(3, "An X-ray")], "id long, variation string")
    got = identity.entity_list(e, variations, links, "X", spark.createDataFrame([(9,)], "source_id long"))
    assert {tuple(r) for r in got.collect()} == {(2, "B x", 1), (3, "C", 0)}
    d = spark.createDataFrame([(1, 5, "S, A"), (2, 5, "S, B")], "document_id long, author_id long, original_name string")
    assert {(r.document_id, r.author_id) for r in identity.separate_variation(d, 5, "S, B", 8).collect()} == {(1, 5), (2, 8)}


def test_color_board_and_fuzzy_score(spark):
    groups = spark.createDataFrame([(1, "normal", "#FF0000", "a | Categoria 2 : Tools"), (2, "normal", "", None), (3, "noise", "#ff0000", None), (4, "normal", "#ff0000 ", "Categoria 2: Tools|x")], "id int, type string, color string, description string")
    assigned = spark.createDataFrame([(10, 1), (10, 4), (11, 1), (11, 3)], "document_id long, group_id int")
    assert {tuple(r) for r in enrichment.color_board(groups, assigned).collect()} == {("#ff0000", "2. Tools", 2, 3), ("#4f8ef7", None, 1, 0)}
    rows = spark.createDataFrame([("word", "world", None, None), ("abc", "abcd", None, None), ("graph", "grape", "GRPH", None), ("çãéõ", "çãéo", None, None)], "a string, b string, da string, db string")
    got = [r[0] for r in rows.select(treatment.fuzzy_score(*(F.col(c) for c in ("a", "b", "da", "db")))).collect()]
    assert got == [pytest.approx(80), 0, 0, pytest.approx(75)]


def test_resolve_import_of_names_at_the_same_place(spark, tmp_path):
    """Several new names at one document and position: their ids follow the form, in the query as in its SQL."""
    rows = [(k % 5, 1, 400 + (k * 37) % 500) for k in range(500)] + [(k % 5, 120, k) for k in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(500).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    own = duckdb.connect()
    for t in ("lineitem", "supplier"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = own.sql(catalog.oracle_sql()["resolve_import"]).fetchall()
    got = sorted(map(tuple, catalog.queries()["resolve_import"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and len(got) == 550
    places = {f"writer {k}": (d, p) for d, p, k in reversed(rows)}
    assert [x[2] for x in got if x[1]] == sorted((x[2] for x in got if x[1]), key=lambda n: (*places[n], n))
