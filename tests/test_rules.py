"""Rules on hand cases: expected values are worked out from the rules, not from the queries' own SQL."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import formula, text
from lodestone.operators import coverage, graph, index, ontology, ordered, similarity, state


def values(spark, *cs):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first())


def test_relation_rules(spark):
    case = lambda s, a, x, i: values(spark, similarity.relation(F.lit(s), F.lit(a), F.lit(x), F.lit(i)))[0]
    assert tuple(case(0.2, 0.9, 0.8, 0.9)) == ("lexical_resemblance", 0.8)
    assert tuple(case(0.25, 0.5, 0.8, 0.5)) == ("analogy", 0.5)
    label, confidence = case(0.6, 0.1, 0.75, 0.55)
    assert label == "shared_mathematical_form" and abs(confidence - 0.76) < 1e-9
    assert case(1.0, 0.1, 0.0, 1.0).confidence == 0.9
    assert case(0.9, 0.45, 0.0, 0.54).label == "analogy" and case(0.9, 0.44, 0.0, 0.5).label == "unresolved"
    d = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "task double, math double, operator double, constraint double, topology double, stochastic double, complexity double, method double, semantic double, lexical double, citation double")
    a, i = d.select(similarity.aggregate(), similarity.independence(F.col("lexical"), F.col("citation"))).first()
    assert abs(a - (0.14 + 0.20 + 0.15 + 0.10 + 0.08 + 0.07 + 0.06 + 0.07 - 0.05)) < 1e-9 and abs(i) < 1e-9


def test_candidate_rules(spark):
    rows = [(1, 2, "a", "b", 0.35, 0.65, 0.50, 0.3), (1, 3, "a", "a", 0.9, 0.1, 0.0, 0.9), (1, 4, "a", "unknown", 0.9, 0.1, 0.0, 0.9), (1, 5, "a", "b", 0.34, 0.1, 0.0, 0.0), (1, 6, "a", "b", 0.9, 0.72, 0.6, 0.4), (1, 7, "a", "c", 0.0, 1.0, 1.0, 0.3)]
    d = spark.createDataFrame(rows, "left_id int, right_id int, left_task string, right_task string, structure double, lexical double, citation double, aggregate double")
    assert [r.right_id for r in similarity.candidates(d).collect()] == [2]
    got = [(r.right_id, round(r.score, 6), r.notes) for r in similarity.ranked(d).collect()]
    # 0.72 a + 0.28 (1 - 0.55 x - 0.45 c): 5 scores 0.2646, 2 scores 0.3329, 6 scores 0.38152, 7 scores 0.216
    assert got == [(6, 0.38152, "lexical,citation"), (2, 0.3329, ""), (5, 0.2646, "")]


def test_asset_rules(spark):
    one = lambda r, m=None: values(spark, coverage.asset_rank(F.lit(r), F.lit(m)))[0]
    assert [one(r) for r in ("PDF", "landing_page", "abstract", "source", "latex", "plain_text", "scan", "pdf-version")] == [10, 0, 50, 80, 85, 60, 20, 20]
    assert [one("pdf", m) for m in ("application/jats+xml", "application/tei+xml", "text/html", "text/plain", "application/xhtml+html", None)] == [100, 90, 85, 85, 70, 10] and one("jats", "text/plain") == 100
    rows = [(1, "retrievable", "allowed", "allowed", "pdf", None), (2, "retrievable", "allowed", "denied", "html", None), (3, "gone", "allowed", "allowed", "jats", None), (4, "retrievable", None, "allowed", "jats", None), (5, "retrievable", "allowed", "allowed", "html", None)]
    d = spark.createDataFrame(rows, "id int, availability string, tdm string, retention string, representation string, mime string")
    assert [(r.id, r.score) for r in coverage.rank_assets(d).collect()] == [(5, 70), (1, 10)] and [r.id for r in coverage.rank_assets(d, False).collect()] == [2, 5, 1]


def test_priority_and_feedback(spark):
    score, why = values(spark, *coverage.priority(*[F.lit(x) for x in (0.5, 0.5, 0.9, 0.5, 0.9)]))
    assert abs(score - 0.64) < 1e-9 and why == "large coverage gap,high uncertainty,high recent novelty,historical terminology/decade gap"
    one = lambda s, u, h, g, d: values(spark, coverage.feedback(F.lit(s), F.lit(u), F.lit(h).cast("double"), F.lit(g).cast("double"), F.lit(d).cast("double")))[0]
    assert [one(True, 1, 1, 1, 1), one(False, 1, 1, 1, 1), one(False, 0, 0.6, 1, 1), one(False, 0, 0.5, 0.6, 0.3), one(False, 0, 0.5, 0.6, 0.2), one(False, 0, None, None, None)] == ["saturated", "expand_terms", "target_history", "add_provider", "continue", "review_gap"]


def test_saturation_gate(spark):
    d = spark.createDataFrame([(i, 0.01, i != 5) for i in range(1, 7)], "iteration int, n double, stable boolean")
    got = [r.saturated for r in ordered.saturation(d, F.col("n"), 4, 3, 0.04, F.col("stable")).orderBy("iteration").collect()]
    assert got == [False, False, False, True, False, True]
    assert values(spark, ordered.audited_novelty(F.lit(10), works=F.lit(1), terms=F.lit(2), concepts=F.lit(2), citations=F.lit(5), signatures=F.lit(1)))[0] == pytest.approx(0.51)


def test_urls(spark):
    one = lambda u: values(spark, text.redacted_url(F.lit(u)))[0]
    assert one("https://a.org/p?Key=x&q=a b&q=~*&AUTHORIZATION=z&e=#f") == "https://a.org/p?Key=%3Credacted%3E&q=a+b&q=~%2A&AUTHORIZATION=%3Credacted%3E&e=#f"
    assert [one(u) for u in ("https://a.org", "https://a.org/?", "https://a.org/#x?key=1", "https://a.org/?q=%E9%zz")] == ["https://a.org", "https://a.org/", "https://a.org/#x?key=1", one("https://a.org/?q=%E9%zz")]


def test_identifiers(spark):
    one = lambda v: (lambda x: x and tuple(x))(values(spark, text.parse_identifier(F.lit(v)))[0])
    assert one("HTTPS://DOI.ORG/10.1/AbC?x") == ("doi", "10.1/abc") and one("doi:10.1/X") == ("doi", "10.1/x") and one("10.x/Y") == ("doi", "10.x/y")
    assert one("PMC12") == ("pmcid", "PMC12") and one("PMC") is None and one("https://api.openalex.org/works/W1/") == ("openalex", "W1") and one("W12x") is None and one("") is None


def test_formula_rules(spark):
    f = values(spark, formula.features(F.lit(r"\left( x1 + y \right) [a] \prod_k k")))[0]
    assert (f.commands, f.symbols, f.operators) == (["left", "prod", "right"], ["a", "k", "y"], ["commutator", "product"])
    assert f.has_inequality and not f.has_equality  # \left holds \le
    a, b = formula.fingerprint(F.lit("u + v = 2")), formula.fingerprint(F.lit("p + q = 2"))
    c = values(spark, formula.compare(a, b))[0]
    # alpha and relation agree; of the tokens + = 2 are shared, 3 of 7
    assert (c.exact, c.alpha, c.relation, c.operator) == (0, 1, 1, 0) and c.token == pytest.approx(3 / 7) and c.score == pytest.approx(0.30 + 0.25 * 3 / 7 + 0.10)
    r = values(spark, text.relation(text.latex_tokens(F.lit("a <= b = c"))))[0]
    assert tuple(r) == ("equals", "a <= b", "c") and values(spark, text.relation(text.latex_tokens(F.lit("a b"))))[0] is None
    m = values(spark, text.multiset(F.split(F.lit("b a b c b"), " ")))[0]
    assert m == {"a": 1, "b": 3, "c": 1} and values(spark, text.multiset(F.array().cast("array<string>")))[0] == {}


def test_last_judgment_counts(spark):
    r = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, work string, rank int")
    j = spark.createDataFrame([("q", "a", 0, 2), ("q", "a", 3, 1), ("q", "b", 3, 1)], "query string, work string, relevance int, ord int")
    m = index.retrieval_metrics(r, j, 2).first()
    assert m.mrr == 0.5 and m.precision == 0.5 and m.ndcg == pytest.approx(0.63093, abs=1e-5)


def test_coverage_report(spark):
    row = lambda p, d: ("x", d, "en", "article", p, "open")
    d = spark.createDataFrame([row("p", "1990s")] * 8 + [row("", "1990s"), row(None, None)], "discipline string, decade string, language string, document_type string, provider string, access string")
    got = {(r.kind, r.value): r.n for r in coverage.strata(d).collect()}
    assert got["provider", "unknown"] == 2 and got["decade", "unknown"] == 1 and got["missing", "provider"] == 2 and got["warning", "provider"] == 2 and ("warning", "decade") not in got
    assert got["stratum", "x|1990s|en|article|p|open"] == 8 and not [x for x in spark.catalog.listTables() if x.name.startswith("_")]


def test_shared_neighbours_of_hot_targets(spark):
    edges = [(n, t) for n in range(40) for t in (["hot"] if n % 3 else ["hot", "warm"]) + [f"c{n // 2}"]] + [(3, "hot"), (None, "hot")]
    d = spark.createDataFrame(edges, "src int, dst string")
    has = {n: {t for m, t in edges if m == n} for n in range(40)}
    want = {(a, b): len(has[a] & has[b]) for a in has for b in has if a < b and has[a] & has[b]}
    for block in (4, 1024):
        got = {(r.left_id, r.right_id): r.shared for r in graph.shared_neighbours(d, "src", "dst", 1, block).collect()}
        assert got == want
        two = {(r.left_id, r.right_id): r.shared for r in graph.shared_neighbours(d, "src", "dst", 2, block).collect()}
        assert two == {k: n for k, n in want.items() if n >= 2}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(13)], "id int, parent_id int")
    assert graph.descendants(chain, 0).count() == 13
    with pytest.raises(ValueError):
        graph.descendants(chain, 0, 5)


def test_numbering_and_batches(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").cast("string").alias("text"))
    got = {r.k: r.place for r in ordered.numbered(d, [F.col("k")], "place").collect()}
    assert got == {k: k for k in range(1000)}
    b = ordered.batches(d, [F.col("k")], "text", 300).orderBy("batch").collect()
    assert [(r.batch, r.offset, r.n) for r in b] == [(0, 0, 300), (1, 300, 300), (2, 600, 300), (3, 900, 100)]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "id int, work_id string, v string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "w"), (None, "m", "k")], "id int, work_id string, v string")
    told = lambda name: sorted(((r.id or 0), r.work_id, r.v) for r in state.store(name, old, new).collect())
    assert told("problem") == [(0, "m", "k"), (1, "a", "x"), (2, "c", None), (3, "d", "w")]
    assert told("quality") == [(0, "n", "z"), (1, "a", "x"), (2, "b", "y"), (3, "d", "w")]
    assert told("asset") == [(0, "n", "k"), (1, "a", "x"), (2, "b", None), (3, "d", "w")] and len(told("envelope")) == 6
    for name, (key, how) in state.STORES.items():
        cols = [*key, *(["work_id"] if how.startswith("keep") else []), "v"]
        one = spark.createDataFrame([tuple("1" for _ in cols)], ", ".join(f"{c} string" for c in cols))
        assert state.store(name, one, one).count() == (2 if how == "append" else 1), name


def test_terms(spark):
    kinds = ["canonical", "historical", "related", "broader", "synonym", "odd"]
    d = spark.createDataFrame([(k,) for k in kinds], "k string")
    taken = lambda **a: [r.k for r in d.where(ontology.allowed(F.col("k"), **a)).collect()]
    assert taken(mode="precision") == ["canonical", "synonym"] and taken(mode="balanced") == ["canonical", "historical", "synonym", "odd"] and taken(historical=False) == [k for k in kinds if k != "historical"]
    assert [r.w for r in d.select(ontology.weight(F.col("k")).alias("w")).collect()] == [1.5, 1.3, 0.5, 0.7, 1.4, 0.8]
    assert values(spark, text.quoted(F.lit(' a "b"  c ')), text.quoted(F.lit("x[1]")), text.quoted(F.lit("plain"))) == ('"a b c"', '"x[1]"', "plain")
