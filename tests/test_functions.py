from pyspark.sql import functions as F

from lodestone.functions import sets, text
from lodestone.operators import graph, index, ordered
from lodestone.sources import documents, files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_formula_normal_form(spark):
    assert one(spark, text.alpha_normalize(F.lit("A x = lambda x"))) == "v1 v2 = v3 v2"
    assert one(spark, text.alpha_normalize(F.lit(r"\max_k u_k > 7"))) == r"\max_v1 v2_v1 > 7"
    assert one(spark, text.latex_tokens(F.lit(r"x_1 <= \left( y [z] )"))) == ["x_1", "<=", r"\left", "(", "y", "[", "z", "]", ")"]
    assert one(spark, text.latex_tokens(F.lit("x1 | y_a? 2.5")))  == ["x1", "y_a", "2.5"]


def test_reference_ids(spark):
    got = one(spark, text.reference_ids(F.lit("see doi:10.1234/ABC.123. PMID: 12345678 arXiv:2401.01234v2")))
    assert got == {"doi": "10.1234/abc.123", "pmid": "12345678", "arxiv": "2401.01234v2"}


def test_empty_sets(spark):
    e = F.array().cast("array<string>")
    assert one(spark, sets.jaccard(e, e)) == 0 and one(spark, sets.jaccard(e, e, 1.0)) == 1
    assert one(spark, sets.overlap(e, e)) == 0.5
    assert [one(spark, c) for c in sets.precision_recall_f1(e, e)] == [1, 1, 1]


def test_graph(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "y")], "src string, dst string")
    assert graph.shared_neighbours(e, "src", "dst").collect()[0].shared == 2
    c = graph.components(e.toDF("a", "b")).collect()
    assert {r.label for r in c} == {"a"} and len(c) == 4
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 60), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(13)}, 50: 50, 60: 50}
    assert graph.components(chain.where("false")).count() == 0


def test_retrieval_metrics(spark):
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, work string, rank int")
    j = spark.createDataFrame([("q", "b", 3)], "query string, work string, relevance int")
    m = index.retrieval_metrics(r, j, 3).first()
    assert abs(m.precision - 1 / 3) < 1e-9 and m.recall == 1 and m.mrr == 0.5 and abs(m.ndcg - 0.63093) < 1e-5


def test_saturation(spark):
    d = spark.createDataFrame([(1, 0.04), (2, 0.03), (3, 0.02)], "iteration int, n double")
    assert [r.saturated for r in ordered.saturation(d, F.col("n"), 3, 3, 0.05).orderBy("iteration").collect()] == [False, False, True]


def test_parsers(spark):
    tex = r"\title{T}\section{One} a \begin{equation}x=1\end{equation} \[y\] \begin{thebibliography}\bibitem{k} Ref.\end{thebibliography}"
    d = one(spark, documents.latex(F.lit(tex)))
    assert d.title == "One" and d.sections[0].title == "One" and d.equations == ["x=1", "y"] and d.refs == ["Ref."]
    h = one(spark, documents.parser("HTML")(F.lit("<h1>A&amp;B</h1><p>x</p>")))
    assert h.title == "A&B" and h.sections[0].text == "A&B\nx"
    j = one(spark, documents.jats(F.lit("<a><body><sec><title>S</title><p>t</p></sec></body></a>")))
    assert j.sections[0].title == "S" and j.sections[0].text == "t"


def test_jsonl(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "ä")], "a int, b string"), str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").collect()[0].b == "ä"


def test_harvest_resumes(spark, tmp_path):
    from lodestone.streaming import harvest

    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        harvest.harvest(harvest.file_stream(spark, src, "id int, v string"), sink, ck, ["id"])
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]
