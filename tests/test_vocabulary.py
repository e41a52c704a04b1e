"""Terms counted by arrays against all terms of each document."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import vocabulary


def brute(docs, known, most, least, limit):
    tf, df, own = Counter(), Counter(), {}
    for i, words in docs:
        own.setdefault(i, []).append([w for w in words or [] if w is not None])
    for rows in own.values():
        c = Counter(" ".join(r[p : p + k]) for r in rows for k in range(1, most + 1) for p in range(len(r) - k + 1))
        tf.update(c)
        df.update(c.keys())
    found = [(-tf[t] * (1 + 0.25 * t.count(" ")) * math.log1p(len(docs) / df[t]), -df[t], t) for t in tf if df[t] >= least and t not in known]
    return [(t, tf[t], -d) for _, d, t in sorted(found)[:limit]]


def check(spark, docs, known=(), most=3, least=2, limit=20):
    d = spark.createDataFrame(docs, "id long, text array<string>").repartition(3)
    k = spark.createDataFrame([(x,) for x in known], "term string")
    got = [(r.term, r.tf, r.df) for r in vocabulary.mine_terms(d, k, F.col("text"), most, least, limit).collect()]
    assert got == brute(docs, set(known), most, least, limit) and got


def test_terms_are_those_of_all_documents(spark, monkeypatch):
    docs = [(i, [f"w{(i * 7 + p * p) % (3 + p % 11)}" for p in range(i % 40)] + ["run"] * (40 * (i == 9 or i == 10)) + [f"r{i}"]) for i in range(60)] + [(97, None), (98, []), (99, ["a", None, "b"])]
    for size in (1 << 20, 8):
        monkeypatch.setattr(vocabulary, "PIECE", size)
        check(spark, docs)
        check(spark, docs, known=["w1", "run", "w0 w1"])
        check(spark, docs, most=1)
        check(spark, docs, limit=500)
        check(spark, docs, least=1, limit=30)


def test_rows_of_one_id_are_one_document_and_words_may_have_spaces(spark):
    docs = [(i % 9, ["x", f"y{i % 4}", f"z{i % 5}"] * (i % 3)) for i in range(40)] + [(100 + i, ["x", "y1", "q"]) for i in range(6)] + [(None, ["x", "n"])] * 2
    check(spark, docs)
    check(spark, docs, limit=3)
    check(spark, [*docs, (200, ["x y1", "q"]), (201, ["x", "y1 q"])])


def test_longer_terms_are_made_of_words_that_can_reach(spark):
    """Of rare words no longer term is made, and no row is moved for a term of a document."""
    seen = []
    docs = spark.createDataFrame([(i, ["the", "common", "pair"] * 5 + [f"rare{i}", f"rare{i + 1}"]) for i in range(50)], "id long, text array<string>")
    count = vocabulary.term_counts

    def told(*a, **k):
        seen.append(a[4] if len(a) > 4 else k.get("among"))
        return count(*a, **k)

    vocabulary.term_counts = told
    try:
        got = vocabulary.mine_terms(docs, None, F.col("text"), limit=3)
        assert got.count() == 3 and sorted(seen[-1]) == ["common", "pair", "the"]
    finally:
        vocabulary.term_counts = count
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()


def test_counts_by_language(spark):
    docs = spark.createDataFrame([("de", ["a", "b", "a"]), ("de", ["a"]), (None, ["a"]), ("fr", None), ("fr", ["b", "a"])], "lang string, words array<string>").coalesce(1)
    got = {(r.by, r.term): (r.tf, r.df, r.most) for r in vocabulary.term_counts(docs, F.col("words"), F.col("lang")).collect()}
    assert got == {("de", "a"): (3, 2, 2), ("de", "b"): (1, 1, 1), (None, "a"): (1, 1, 1), ("fr", "a"): (1, 1, 1), ("fr", "b"): (1, 1, 1)}


def test_words_by_language_are_counted_before_they_move(spark):
    from lodestone.plans import text_queries  # noqa: F401
    from lodestone.plans.registry import QUERIES

    plan = QUERIES["token_multiset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan
