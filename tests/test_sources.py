"""Readers, stores, harvests and runs on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import json as j
from lodestone.plans import runs
from lodestone.sources import documents, files
from lodestone.streaming import harvest


def test_vocabularies(spark, tmp_path):
    (tmp_path / "a.obo").write_text('format: 1\n! note\n\n[Term]\nid: X:1\nname: one\ndef: "first"\nsynonym: "uno" EXACT []\nis_a: X:0 ! root\nis_obsolete: TRUE\nreplaced_by: X:9\n\n[Typedef]\nid: t\nname: t\n\n[Term]\nid: X:2\n\n[Term]\nid: X:3\nname: three\n')
    got = {r.native_id: r for r in files.read_obo(spark, str(tmp_path / "a.obo")).collect()}
    assert sorted(got) == ["X:1", "X:3"]
    one = got["X:1"]
    assert (one.label, one.alternate, one.broader, one.definition, one.deprecated, one.replaced_by) == ("one", ["uno"], ["X:0"], '"first"', True, ["X:9"])
    (tmp_path / "s.rdf").write_text('<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="u1"><skos:prefLabel> P </skos:prefLabel><skos:altLabel>a</skos:altLabel><skos:definition>d</skos:definition><skos:broader rdf:resource="u0"/><skos:narrower rdf:resource="u2"/><skos:related rdf:resource="u3"/></skos:Concept><skos:Concept><skos:prefLabel>none</skos:prefLabel></skos:Concept></rdf:RDF>')
    s = files.read_skos(spark, str(tmp_path / "s.rdf")).collect()
    assert [(r.native_id, r.label, r.alternate, r.broader, r.narrower, r.related, r.definition) for r in s] == [("u1", "P", ["a"], ["u0"], ["u2"], ["u3"], "d")]
    (tmp_path / "n.jsonl").write_text('{"native_id":"n","label":"l","broader":["b"]}\n')
    assert files.read_native(spark, str(tmp_path / "n.jsonl")).first().broader == ["b"]
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    after, n = files.import_absent(old, spark.createDataFrame([(1, "x"), (2, "b"), (2, "b")], "k int, v string"), ["k"])
    assert n == 1 and sorted(map(tuple, after.collect())) == [(1, "a"), (2, "b")]
    assert spark.range(1).select(files.split_list(F.lit(" a; ;b ")).alias("x")).first().x == ["a", "b"]


def test_blobs_and_swaps(spark, tmp_path):
    d = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "id int, content binary")
    keys = {r.id: r.key for r in files.put_blobs(d, str(tmp_path / "b")).collect()}
    files.put_blobs(d, str(tmp_path / "b"))
    assert keys[1] == keys[2] != keys[3] and keys[1].startswith("sha256/2d/2d7116") and files.get_blobs(spark, str(tmp_path / "b")).count() == 2
    for n in (3, 5):
        files.atomic_write(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    with pytest.raises(Exception):
        files.atomic_write(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 and files.healthy(spark)


def test_exports(spark, tmp_path):
    parts = {"work": spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int"), "identifier": spark.createDataFrame([("a", "doi", "1")], "work_id string, scheme string, value string"), "asset": spark.createDataFrame([], "work_id string, id string"), "citation": spark.createDataFrame([("a", "b", "p")], "source string, target string, provider string"), "problem": spark.createDataFrame([], "id string")}
    told = files.export_corpus(parts, str(tmp_path / "c"))
    rows = [x for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text().splitlines()]
    assert told == {"work": 2, "identifier": 1, "asset": 0, "citation": 1, "problem": 0}
    assert rows[0] == '{"type":"work","data":{"id":"a","n":2}}' and len(rows) == 4 and "citation" in rows[3]
    assert files.write_schemas(parts, str(tmp_path / "s")) == 5
    files.save_catalog(parts["work"], str(tmp_path / "cat"), "1")
    assert {r.catalog_version for r in files.load_catalog(spark, str(tmp_path / "cat"), "id string, n int").collect()} == {"1"}
    search = files.json_source(lambda v: j.items(v, "hits"), lambda r: F.when(j.text(r, "t").isNotNull(), F.struct(j.text(r, "t").alias("title"))))
    raw = spark.createDataFrame([('{"hits":[{"t":"a"},{"x":1},{"t":"b"}]}',)], "raw string")
    assert [(r["rank"], r.title) for r in search(raw, "raw").collect()] == [(1, "a"), (3, "b")]
    assert files.fixture(spark, [(1,), (2,), (3,)], "a int", 2).count() == 2


def test_html_rules(spark):
    d = spark.range(1).select(documents.html(F.lit("<html><style>p{}</style><h2> Two <i>words</i></h2><div>a</div>\n \n<p>b &amp; c<br>d</p><script>x()</script></html>")).alias("d")).first().d
    assert d.title == "Two words" and d.sections[0].text.split("\n")[0] == "p{} Two words" and "x()" in d.sections[0].text and "\n\n\n" not in d.sections[0].text and "b & c\nd" in d.sections[0].text


def test_pages_resume_and_stop(spark, tmp_path):
    state, sink, calls = str(tmp_path / "s"), str(tmp_path / "o"), []

    def source(fail_at=None, last=3):
        def fetch(cursor, page):
            calls.append((cursor, page))
            if page == fail_at:
                raise OSError("down")
            return spark.createDataFrame([(f"w{page}",), ("w0",), (None,)], "work_id string"), (f"c{page + 1}" if page < last else None)

        return fetch

    first = harvest.harvest_pages(spark, "a", "f", source(fail_at=2), state, sink)
    assert (first.pages, first.hits, first.exhausted, len(first.errors)) == (2, 6, False, 1) and calls == [(None, 0), ("c1", 1), ("c2", 2)]
    again = harvest.harvest_pages(spark, "a", "f", source(), state, sink)
    assert (again.pages, again.exhausted) == (2, True) and calls[3:] == [("c2", 2), ("c3", 3)] and abs(again.novelty[0] - 1 / 3) < 1e-9
    assert harvest.harvest_pages(spark, "a", "f", source(), state, sink).pages == 0 and len(calls) == 5
    capped = harvest.harvest_pages(spark, "b", "f", source(last=99), state, sink, max_pages=2)
    assert capped.pages == 2 and harvest.harvest_pages(spark, "c", "f", source(last=99), state, sink, max_records=4).hits == 6
    stale = lambda cursor, page: (spark.createDataFrame([("w0",)], "work_id string"), f"c{page + 1}")
    told = harvest.harvest_pages(spark, "d", "f", stale, state, sink, saturated=harvest.no_news(3, 2, 0.03))
    assert told.saturated and told.pages == 3
    both, works = harvest.harvest_sources(spark, {"x": source(fail_at=0), "y": source()}, "g", state, sink)
    assert both["x"].errors and both["y"].exhausted and works.count() == 4
    batch = lambda q: spark.createDataFrame([(q,)], "work_id string")
    assert harvest.harvest_batch(spark, "batch", ["q", "r"], batch, state, sink).pages == 2
    resumed = harvest.harvest_batch(spark, "batch", ["q", "r", "s"], batch, state, sink)
    assert resumed.pages == 1 and resumed.exhausted and len(resumed.novelty) == 3


def test_runs(spark, tmp_path):
    r = runs.Runner().add("a", lambda: ("a", "completed")).add("b", lambda: ("b", "failed")).add("c", lambda: ("c", "completed"))
    assert r.run() == [("a", "completed"), ("b", "failed")]
    with pytest.raises(ValueError):
        runs.Runner().add("a", lambda: ("b", "completed")).run()
    assert [runs.iteration("planned", "start"), runs.iteration("running", "finish", "saturated"), runs.iteration("running", "finish", "continue")] == ["running", "saturated", "completed"]
    runs.require_boundary("gateway")
    with pytest.raises(PermissionError):
        runs.require_boundary("direct")
    docs = spark.createDataFrame([("w", "text")], "work_id string, text string")
    one = lambda task, c: lambda d: d.select("work_id", F.lit(f"{task}{c}").alias("id"), F.lit(task).alias("task"), F.lit("The  Same").alias("statement"), F.lit(c).alias("confidence"))
    best, votes, told = runs.ensemble({"x": one("t", 0.4), "y": one("t", 0.4), "z": one("u", 0.9)}, docs)
    assert sorted((b.task, b.extractor) for b in best.collect()) == [("t", "x"), ("u", "z")] and votes.count() == 3 and told.count() == 2
    assert docs.select(runs.embed(F.col("text"), lambda ts: [[float(len(t))] for t in ts]).alias("v")).first().v == [4.0]
    f = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "family string, n int")
    p = runs.propose_and_evaluate(f, lambda d: d.groupby("family", as_index=False).n.sum().rename(columns={"n": "proposal"}), "family string, proposal long")
    assert sorted(map(tuple, p.collect())) == [("f", 3, "unresolved"), ("g", 3, "unresolved")]
    steps = runs.campaign({"compile": lambda m: spark.range(3), "batch": lambda m: m["compile"].where("id > 0")})
    assert sorted(map(tuple, steps["summary"].collect())) == [("batch", 2), ("compile", 3)]


def test_ingest_and_analyse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("  hello  ")
    (tmp_path / "in" / "b.tex").write_text(r"\section{S} body")
    assets = spark.createDataFrame([(1, "a.txt", "retrievable", "allowed", "allowed", None, "plain_text"), (2, "b.tex", "retrievable", "allowed", "allowed", None, "tex"), (3, "a.txt", "gone", "allowed", "allowed", None, "text"), (4, "a.txt", "retrievable", "allowed", None, None, "text")], "id int, file string, availability string, tdm string, retention string, mime string, representation string")
    parsed, audit = runs.ingest(spark, assets, str(tmp_path / "in"), str(tmp_path / "blobs"))
    assert {r.id: r.document.sections[0].text for r in parsed.collect()} == {1: "hello", 2: "body"}
    assert {r.id: r.outcome for r in audit.collect()} == {1: "fetched", 2: "fetched", 3: "tdm:not_retrievable", 4: "retention:rights_unknown"}
    documents_ = spark.createDataFrame([(1, [("body", "we seek a method", 2)], ["r"])], "id int, sections array<struct<kind string, text string, equations int>>, references array<string>")
    views = ", ".join(f"{v} array<string>" for v in ("math", "operator", "constraint", "topology", "method", "lexical"))
    problems = spark.createDataFrame([(i, "t", None, ["m"], ["o"], [], [], [], ["x"]) for i in (1, 2)], f"id int, task string, stochastic string, {views}")
    covered = spark.createDataFrame([("d", "", "en", None, "p", "open")], "discipline string, decade string, language string, document_type string, provider string, access string")
    scopes = spark.createDataFrame([("s", 0.1, 0.9, 0.7, 0.2, 0.4)], "scope string, u double, n double, g double, h double, d double")
    yields = spark.createDataFrame([(1, 10, 5, 0, 0, 0, 0)], "iteration int, retrieved int, works int, terms int, concepts int, citations int, signatures int")
    out = runs.analyse(documents_, problems, ["math", "topology"], covered, scopes, yields, True)
    told = out["intelligence"].first()
    assert (told.problem_sections, told.method_sections, told.math_dense, told.warnings) == (1, 1, 1, [])
    assert out["feedback"].first().action == "add_provider" and out["pairs"].count() == 1 and out["quality"].first().missing == ["topology"]
    assert ("missing", "decade", 1) in {tuple(r) for r in out["coverage"].collect()} and ("warning", "decade", 1) in {tuple(r) for r in out["coverage"].collect()}
