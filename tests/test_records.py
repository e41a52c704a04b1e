"""Record operators on small fixtures: nulls, empties, ties, empty tables."""

from pyspark.sql import functions as F

from lodestone.operators import records


def test_completeness(spark):
    d = spark.createDataFrame([(1, "x", ["a"]), (2, "", []), (3, None, None)], "id int, a string, b array<string>")
    got = {r.id: (r.n_filled, r.completeness, r.missing) for r in records.completeness(d, ["a", "b"]).collect()}
    assert got == {1: (2, 1.0, []), 2: (0, 0.0, ["a", "b"]), 3: (0, 0.0, ["a", "b"])}


def test_ambiguity(spark):
    d = spark.createDataFrame([("sorting", "v1", 0.9), ("unknown", None, 0.4), (None, "", None)], "task string, version string, confidence double")
    got = [r.f for r in d.select(records.ambiguity(F.col("task"), F.col("version"), F.col("confidence")).alias("f")).collect()]
    every = ["unknown task", "version not pinned", "low confidence"]
    assert got == [[], every, every]


def test_evidence_span(spark):
    d = spark.createDataFrame([("b" * 500 + "Graph" + "c" * 9,), ("Graph",), ("",), (None,), ("query and graph",)], "text string")
    got = [r.s and tuple(r.s) for r in d.select(records.evidence_span(F.col("text"), ["graph", "quer"]).alias("s")).collect()]
    assert got == [(320, 514, "graph"), (0, 5, "graph"), None, None, (0, 15, "graph")]


def test_source_format(spark):
    d = spark.createDataFrame([("application/jats+xml", None), ("image/png", "LaTeX"), (None, "html"), ("text/plain", "x"), ("image/png", "abstract"), (None, None)], "m string, r string")
    assert [r.f for r in d.select(records.source_format(F.col("m"), F.col("r")).alias("f")).collect()] == ["jats", "latex", "html", "latex", "text", None]


def test_possible_identities(spark):
    titles = [("A study of graphs, in six words", 2000), ("a STUDY of graphs in six words!", 2001), ("a study of graphs in six words", 2009), ("a study of graphs in six words", None), ("", 2000), (None, 2000), ("of of of", 2000), ("a study of graphs in six more words", 2000)]
    d = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(titles)], "id int, title string, year int")
    words = [set("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for t, _ in titles]
    want = {}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i < j and a and b:
                x, y = titles[i][1], titles[j][1]
                s = len(a & b) / len(a | b) * (0.5 if x and y and abs(x - y) > 1 else 1)
                if s >= 0.82:
                    want[i, j] = round(s, 6)
    assert {(r.left_id, r.right_id): r.score for r in records.possible_identities(d).collect()} == want
    assert records.possible_identities(d.limit(0)).count() == 0


def test_disagreement(spark):
    d = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x")], "item int, extractor string, family string")
    got = sorted((r.item, r.left, r.right) for r in records.disagreement(d).collect())
    assert got == [(1, "a", "c"), (1, "b", "c")]
