"""Table sets, records with children, observed tallies, campaigns, expansion, identity and thresholds, by hand."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import children, evaluation, expansion, graph, identity, observed, problems
from lodestone.plans.campaign import Stage, ledger, run_campaign
from lodestone.sources.tableset import Changes, current, healthy, table


def test_table_set(spark, tmp_path):
    at = str(tmp_path / "s")
    assert table(spark, at, "a") is None and healthy(spark, at) and current(spark, at) == (0, {})
    with Changes(spark, at) as c:
        c["a"], c["b"] = spark.range(3), spark.range(5)
    with Changes(spark, at) as c:
        c["a"] = c["a"].unionByName(spark.range(10, 12))
    assert current(spark, at) == (2, {"a": 2, "b": 1})
    assert (table(spark, at, "a").count(), table(spark, at, "b").count(), table(spark, at, "a", 1).count()) == (5, 5, 3)
    boom = spark.range(9).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception), Changes(spark, at) as c:
        c["a"], c["b"] = spark.range(1), boom  # the first is written, the second fails
    assert current(spark, at)[0] == 2 and table(spark, at, "a").count() == 5 and healthy(spark, at)
    with pytest.raises(KeyError), Changes(spark, at) as c:
        c["a"] = spark.range(1)
        raise KeyError("by the caller")
    one, two = Changes(spark, at), Changes(spark, at)
    one["a"], two["a"] = spark.range(7), spark.range(8)
    one.__exit__(None, None, None)
    with pytest.raises(RuntimeError):
        two.__exit__(None, None, None)
    assert table(spark, at, "a").count() == 7


PROBLEM = "id string, work_id string, task_family string, statement string, confidence double, evidence array<string>, objects array<struct<name:string,object_type:string,representation:string,role:string>>, known_methods array<struct<name:string,method_type:string,role:string>>, classical_baselines array<struct<name:string,method_type:string,role:string>>"


def test_children_and_runs(spark, tmp_path):
    at = str(tmp_path / "p")
    docs = spark.createDataFrame([("w1",), ("w2",)], "work_id string")

    def good(d):
        rows = [("p1", "w1", "search", "s", 0.3, ["e1", "e2"], [("m", "matrix", None, None)], [("cg", None, None)], []), ("p2", "w2", "search", "t", 0.4, None, None, None, None)]
        return spark.createDataFrame(rows, PROBLEM)

    def bad(d):
        return good(d).withColumn("statement", F.raise_error(F.lit("broken")).cast("string"))

    assert children.extract_and_store(spark, at, docs, "x", good) == "completed"
    assert sorted((r.work_id, r.status, r.problem_count) for r in table(spark, at, "runs").collect()) == [("w1", "completed", 1), ("w2", "completed", 1)]
    before = sorted(table(spark, at, "problems").collect())
    assert children.extract_and_store(spark, at, docs, "y", bad) == "failed"
    assert sorted(table(spark, at, "problems").collect()) == before
    assert {(r.extractor, r.status, bool(r.error)) for r in table(spark, at, "runs").collect()} == {("x", "completed", False), ("y", "failed", True)}
    with Changes(spark, at) as c:
        children.put_problems(c, good(docs).where("id = 'p1'").withColumn("evidence", F.array(F.lit("only"))))
    assert [(r.problem_id, r.place, r.quote) for r in table(spark, at, "problem_evidence").collect()] == [("p1", 0, "only")]
    assert [(r.problem_id, r.role) for r in table(spark, at, "problem_methods").collect()] == [("p1", "known_method")] and table(spark, at, "objects").count() == 1


def test_validated_and_audit(spark, tmp_path):
    d = spark.range(10).withColumn("x", F.when(F.col("id") < 8, F.col("id")))
    told, seen = observed.validated(d, {"x": F.col("x") > 1, "even": F.col("id") % 2 == 0})
    assert told.where("size(faults) = 0").count() == 3 and seen.get == {"total": 10, "valid": 3, "invalid": 7, "broken_x": 4, "broken_even": 5}
    audit = observed.Audit("tally")
    spark.streams.addListener(audit)
    try:
        for k in range(2):
            spark.range(k * 5, k * 5 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rules = {"small": F.col("id") < 7}
        stream = observed.checked(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), rules).observe("tally", *observed.tallies(rules))
        stream.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
        until = time.time() + 20
        while (sum(r["total"] for r in audit.rows) < 10 or not audit.ended) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(audit)
    assert sum(r["valid"] for r in audit.rows) == 7 and sum(r["broken_small"] for r in audit.rows) == 3 and audit.ended == [None]


def test_campaign(spark, tmp_path):
    at, calls = str(tmp_path / "c"), []

    def made(name, fail=False):
        def run(inputs, p):
            calls.append(name)
            if fail and calls.count(name) == 1:
                raise ConnectionError("away")
            return spark.range(p.get("n", 1) + sum(d.count() for d in inputs.values()))

        return run

    def stages(n=2):
        return [Stage("compile", made("compile"), parameters={"n": n}), Stage("harvest", made("harvest", True), ("compile",)), Stage("other", made("other")), Stage("enqueue", made("enqueue"), ("harvest", "other"))]

    first = run_campaign(spark, at, stages())
    assert (first.status, first.ran, calls) == ("failed", ["compile"], ["compile", "harvest"]) and "away" in first.error
    second = run_campaign(spark, at, stages())
    assert (second.status, second.skipped, second.ran) == ("completed", ["compile"], ["harvest", "other", "enqueue"]) and second.tables["enqueue"].count() == 5
    assert run_campaign(spark, at, stages()).ran == []
    changed = run_campaign(spark, at, stages(4))
    assert changed.ran == ["compile", "harvest", "enqueue"] and changed.skipped == ["other"] and changed.tables["enqueue"].count() == 7
    assert run_campaign(spark, at, stages()).ran == [] and ledger(spark, at).where("status = 'failed'").count() == 1
    with pytest.raises(ValueError):
        run_campaign(spark, at, [Stage("a", made("a"), ("b",))])


def test_expansion_goes_on(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", None, 0), ("b", "d", 1), ("c", "d", 1), ("d", "a", 1), ("x", "a", 5)], "source string, target string, ord int")
    seeds = spark.createDataFrame([("a", 1), ("a", 2), ("z", 0), (None, 0)], "id string, ord int")
    told = lambda d: [(r.round, r.seed, r.direction, r.source, r.target) for r in d.orderBy("round", "place", "direction", "rank").collect()]
    one = told(expansion.expand(edges, seeds, f"{tmp_path}/e", 5, 10, 1))
    assert one == [(0, "a", "cited_by", "d", "a"), (0, "a", "cited_by", "x", "a"), (0, "a", "references", "a", "b"), (0, "a", "references", "a", "c")]
    # the second call reads the first round from its table, though the edges are gone from it
    more = told(expansion.expand(edges.where("target <> 'a'"), seeds, f"{tmp_path}/e", 5, 10, 2))
    assert more[:4] == one and {m[1] for m in more[4:]} == {"b", "c", "d"}
    few = told(expansion.expand(edges, seeds, f"{tmp_path}/f", 5, 1, 1, ("references",)))
    assert few == [(0, "a", "references", "a", "b")]


def test_identity_by_hand(spark):
    rows = [(1, [("doi", "https://DX.doi.org/10.1/Ab"), ("pmid", " 7 ")]), (2, [("doi", "10.1/aB ")]), (3, [("pmid", "7"), ("arxiv", "arXiv:2401.1")]), (4, [("arxiv", "2401.1"), ("pmcid", "pmc9")]), (5, [("pmcid", "PMC9"), (None, "x"), ("doi", None)]), (6, []), (7, [("other", "A")]), (8, [("other", "a")])]
    works = spark.createDataFrame(rows, "id long, identifiers array<struct<scheme:string,value:string>>")
    got = sorted((r.left_id, r.right_id, r.reason.split()[-1]) for r in identity.same_works(works, block=2).collect())
    assert got == [(1, 2, "doi:10.1/ab"), (1, 3, "pmid:7"), (3, 4, "arxiv:2401.1"), (4, 5, "pmcid:PMC9")]
    assert sorted((r.id, r["class"], r.members) for r in identity.work_classes(works).collect()) == [(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 1, 5), (5, 1, 5), (6, 6, 1), (7, 7, 1), (8, 8, 1)]


def test_thresholds_by_hand(spark):
    examples = spark.createDataFrame([(1, 2, True), (2, 1, False), (3, 4, True), (5, 6, False), (7, 8, None)], "left_id long, right_id long, expected boolean")
    scores = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.4), (5, 6, 0.4), (5, 6, 0.2)], "left_id long, right_id long, score double")
    d = evaluation.scored_examples(examples, scores)
    assert sorted(map(tuple, evaluation.confusion_curve(d).collect())) == [(0.0, 2, 3, 0, 0), (0.4, 1, 2, 1, 1), (0.9, 1, 0, 3, 1)]
    m = evaluation.measures(evaluation.confusion_at(d, 0.5)).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.accuracy, m.precision, m.recall) == (1, 0, 3, 1, 0.8, 1.0, 0.5)
    assert evaluation.confusion_curve(d.where("false")).count() == 0


def test_graph_stats(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), ("d", "e")], "src string, dst string")
    assert tuple(graph.stats(e).first()) == (5, 5, 3)


def test_extraction_by_hand(spark):
    texts = {
        1: ["We estimate an eigenvalue of a sparse matrix using repeated matrix-vector operations."],
        2: ["", "Nothing here. a model", "We MINIMIZ it"],
        3: [],
        4: ["plain"],
        5: ["STRASSE Straße. Infer  it", "predict; classif; quadrature " + "x" * 900],
    }
    rows = [(k, f"a{k}", [(f"s{i}", t) for i, t in enumerate(v)]) for k, v in texts.items()] + [(6, "a6", None), (7, "a7", [("s0", None)])]
    docs = spark.createDataFrame(rows, "work_id long, asset_id string, sections array<struct<id:string,text:string>>")
    got = {(r.work_id, r.task_family): r for r in problems.extract(docs).collect()}
    assert sorted(got) == [(1, "eigenproblem"), (1, "estimation"), (2, "differential_equation"), (2, "optimization"), (5, "classification"), (5, "inference"), (5, "prediction")]
    e = got[1, "eigenproblem"]
    assert e.structural_properties == ["sparse"] and e.algorithmic_operations == ["matrix-vector multiplication", "eigenvalue computation"] and e.mathematical_objects == ["matrix"] and round(e.confidence, 9) == 0.34
    assert e.place == 1 and e.span.rule == "keyword:eigenvalue" and e.span.start_char == 0 and e.span.text == texts[1][0] and e.statement == texts[1][0]
    o = got[2, "optimization"]
    assert (o.span.section_id, o.span.rule, o.statement, o.place) == ("s2", "keyword:minimiz", "a model We MINIMIZ it", 0) and got[2, "differential_equation"].span.section_id == "s1"
    c = got[5, "prediction"]
    assert (c.place, c.span.section_id, c.span.start_char, c.span.end_char) == (1, "s1", 0, 7 + 360) and len(c.statement) == 700
