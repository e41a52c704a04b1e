"""Queries on identity, expected pairs, citations of seeds, families and snapshots of coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import coverage, evaluation, expansion, graph, identity, ordered, similarity
from .lineage import shared_folder
from .registry import query

_IDS = """WITH i AS (SELECT p_partkey AS id, unnest(['doi', CASE WHEN p_partkey % 4 = 0 THEN 'pmcid' END, CASE WHEN p_partkey % 3 = 0 THEN 'arxiv' END, 'openalex']) AS scheme,
  unnest(['10.1/k' || p_partkey // 2, 'PMC' || p_size, CASE WHEN p_partkey % 9 > 0 THEN '2401.' || p_partkey // 5 END, 'W' || p_partkey]) AS value FROM part), n AS (SELECT DISTINCT id, scheme || ':' || value AS x FROM i WHERE scheme IS NOT NULL AND value IS NOT NULL)"""


def _works(t):
    k = F.col("p_partkey")
    div = lambda n: F.call_function("div", k, F.lit(n)).cast("string")
    doi = F.when(k % 2 == 0, F.concat(F.lit(" HTTPS://dx.doi.org/10.1/K"), div(2))).otherwise(F.concat(F.lit("10.1/k"), div(2), F.lit(" ")))
    arxiv = F.when(k % 9 > 0, F.concat(F.when(k % 2 == 0, "arXiv:").otherwise(""), F.lit("2401."), div(5)))
    listed = [("doi", doi, F.lit(True)), ("pmcid", F.concat(F.lit("pmc"), F.col("p_size").cast("string")), k % 4 == 0), ("arxiv", arxiv, k % 3 == 0), ("openalex", F.concat(F.lit("W"), k.cast("string")), F.lit(True))]
    return t("part").select(k.alias("id"), F.array(*[F.struct(F.when(c, F.lit(s)).alias("scheme"), v.alias("value")) for s, v, c in listed]).alias("identifiers"))


@query(_IDS + " SELECT a.id AS left_id, b.id AS right_id, 'exact identifier agreement on ' || min(a.x) AS reason, 1.0::DOUBLE AS confidence FROM n a JOIN n b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2")
def exact_identity(t):
    """C11: pairs of works that share an identifier in any spelling, with the smallest one shared."""
    return identity.same_works(_works(t)).select("left_id", "right_id", "reason", "confidence")


@query(_IDS.replace("WITH i", "WITH RECURSIVE i") + ", e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM n a JOIN n b ON a.x = b.x), r AS (SELECT id, id AS reached FROM (SELECT DISTINCT p_partkey AS id FROM part) UNION SELECT e.a, r.reached FROM r JOIN e ON e.b = r.id), c AS (SELECT id, min(reached) AS class FROM r GROUP BY id) SELECT id, class, count(*) OVER (PARTITION BY class) AS members FROM c")
def identity_classes(t):
    """Classes of works that chains of shared identifiers hold together."""
    return identity.work_classes(_works(t))


_EXAMPLES = """WITH x AS (SELECT doc_id AS l, doc_id + 1 AS r, coalesce(quality = 1, false) AS e FROM labels), s AS (SELECT doc_id AS l, doc_id + 1 AS r, n_chars % 41 / 40.0::DOUBLE AS score FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id + 1, doc_id, 0.9 FROM documents),
b AS (SELECT l, r, max(score) AS score FROM s GROUP BY 1, 2), d AS (SELECT e, coalesce(score, 0) AS score FROM x LEFT JOIN b USING (l, r)) """


def _scored(t):
    examples = t("labels").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"), (F.col("quality") == 1).alias("expected"))
    d, other = t("documents"), F.lit(0.9).alias("score")
    scores = d.where("doc_id % 5 > 0").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"), (F.col("n_chars") % 41 / F.lit(40.0)).alias("score"))
    return evaluation.scored_examples(examples, scores.unionByName(d.select((F.col("doc_id") + 1).alias("left_id"), F.col("doc_id").alias("right_id"), other)))


@query(_EXAMPLES + ", g AS (SELECT score, sum(CASE WHEN e THEN 1 ELSE 0 END) AS p, sum(CASE WHEN e THEN 0 ELSE 1 END) AS n FROM d GROUP BY 1), c AS (SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY score DESC)) SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(an - fp AS BIGINT) AS tn, CAST(ap - tp AS BIGINT) AS fn, round((tp + an - fp) / (ap + an)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(ap, 0)::DOUBLE, 0), 6) AS recall FROM c")
def threshold_curve(t):
    """Confusion at every score as a threshold; a pair without a score counts as 0."""
    return evaluation.measures(evaluation.confusion_curve(_scored(t))).select("threshold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall")


@query(_EXAMPLES + ", y AS (SELECT unnest([0.0, 0.33, 0.5, 0.99, 1.5])::DOUBLE AS threshold), c AS (SELECT threshold, sum(CASE WHEN score >= threshold AND e THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold AND NOT e THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < threshold AND NOT e THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN score < threshold AND e THEN 1 ELSE 0 END) AS fn FROM d, y GROUP BY 1) SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(tp + fp + tn + fn AS BIGINT) AS evaluated, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall FROM c")
def threshold_confusion(t):
    """Confusion measures of scored pairs at five thresholds."""
    d = _scored(t)
    parts = [evaluation.measures(evaluation.confusion_at(d, x)).withColumn("threshold", F.lit(x)) for x in (0.0, 0.33, 0.5, 0.99, 1.5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("threshold", "tp", "fp", "tn", "fn", "evaluated", "accuracy", "precision", "recall")


_ROUND = """s{n} AS (SELECT id AS seed, row_number() OVER (ORDER BY ord, id) - 1 AS place FROM ({front}) ORDER BY ord, id LIMIT 15),
m{n} AS (SELECT seed, place, 'references' AS d, source, target, ord FROM e JOIN s{n} ON source = seed UNION ALL SELECT seed, place, 'cited_by', source, target, ord FROM e JOIN s{n} ON target = seed),
k{n} AS (SELECT *, row_number() OVER (PARTITION BY seed, d ORDER BY ord, source, target) AS rank FROM m{n} QUALIFY rank <= 40),
z{n} AS (SELECT place, coalesce(sum(count(*)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k{n} GROUP BY place),
r{n} AS (SELECT {n} AS round, seed, place, d AS direction, rank, source, target FROM k{n} JOIN z{n} USING (place) WHERE before < 40),
f{n} AS (SELECT CASE direction WHEN 'references' THEN target ELSE source END AS id, min(place * 1000000 + CASE direction WHEN 'cited_by' THEN 0 ELSE 100000 END + rank) AS ord FROM r{n} GROUP BY 1)"""


@query("WITH e AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, CAST(l_quantity AS BIGINT) * 7 + l_orderkey % 7 AS ord FROM lineitem), " + ", ".join((
    _ROUND.format(n=0, front="SELECT 'p' || p_partkey AS id, p_size AS ord FROM part"), _ROUND.format(n=1, front="SELECT * FROM f0 WHERE id NOT IN (SELECT seed FROM s0)"), _ROUND.format(n=2, front="SELECT * FROM f1 WHERE id NOT IN (SELECT seed FROM s0 UNION SELECT id FROM f0)"),
)) + " SELECT round, seed, CAST(place AS INTEGER) AS place, direction, CAST(rank AS INTEGER) AS rank, source, target FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)")
def citation_expansion(t):
    """Three rounds of citations from parts, 15 seeds and 40 edges each, in a fixed order."""
    edges = t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), (F.col("l_quantity").cast("long") * 7 + F.col("l_orderkey") % 7).alias("ord"))
    seeds = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_size").alias("ord"))
    return expansion.expand(edges, seeds, f"{shared_folder(edges.sparkSession)}/expansion-{uuid.uuid4().hex}", 15, 40, 3)


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'c' || c_custkey % 50 AS b FROM customer WHERE c_custkey % 50 <> c_nationkey), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS node, a AS reached FROM u UNION SELECT u.a, r.reached FROM r JOIN u ON u.b = r.node), k AS (SELECT node, min(reached) AS label FROM r GROUP BY node), x AS (SELECT CASE WHEN c_custkey % 50 = c_nationkey THEN 'c' || c_custkey % 50 ELSE 'n' || c_nationkey END AS s, 'c' || c_custkey % 50 AS d FROM customer), v AS (SELECT DISTINCT s AS n FROM x UNION SELECT d FROM x) SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM x) AS edges, (SELECT count(DISTINCT label) FROM k) + (SELECT count(*) FROM v WHERE n NOT IN (SELECT node FROM k)) AS components")
def graph_statistics(t):
    """Nodes, edges with repeats, and weak components of a graph with loops."""
    d = F.concat(F.lit("c"), (F.col("c_custkey") % 50).cast("string"))
    s = F.when(F.col("c_custkey") % 50 == F.col("c_nationkey"), d).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return graph.stats(t("customer").select(s.alias("src"), d.alias("dst")))


@query("""WITH m AS (SELECT p_brand AS c, p_partkey AS id, split_part(p_type, ' ', 1) AS task, string_split(p_name, ' ') || [upper(split_part(p_name, ' ', 1))] AS o, [p_type, 'S' || p_size % 5] AS s FROM part),
k AS (SELECT c, task, count(*) AS n, min(id) AS f FROM m GROUP BY 1, 2), x AS (SELECT c, 'o' AS kind, lower(unnest(o)) AS t FROM m UNION ALL SELECT c, 's', lower(unnest(s)) FROM m), h AS (SELECT c, kind, t FROM x GROUP BY ALL HAVING count(*) >= 2)
SELECT c AS component, CAST(sum(n) AS BIGINT) AS members, first(task ORDER BY n DESC, f) AS dominant_task, string_agg(task || ':' || n, '|' ORDER BY task || ':' || n) AS task_counts, coalesce((SELECT string_agg(t, '|' ORDER BY t) FROM h WHERE h.c = k.c AND kind = 'o'), '') AS operations, coalesce((SELECT string_agg(t, '|' ORDER BY t) FROM h WHERE h.c = k.c AND kind = 's'), '') AS structures FROM k GROUP BY c""")
def family_summary(t):
    """Members, tasks, the dominant task, and what a family's members share."""
    name = F.split("p_name", " ")
    m = t("part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("task"), F.concat(name, F.array(F.upper(name[0]))).alias("operations"), F.array(F.col("p_type"), F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string"))).alias("structures"))
    return coverage.families(m).select("component", "members", "dominant_task", F.array_join("task_counts", "|").alias("task_counts"), F.array_join("shared_operations", "|").alias("operations"), F.array_join("shared_structures", "|").alias("structures"))


#: the thirteen tables of a snapshot, as tables here; problems and citations have rows that don't count
_TABLES = {"works": "documents", "problems": None, "retrieval_runs": "events", "provider_requests": "clicks", "assets": "pages", "documents": "documents", "citations": "lineitem", "identity_assertions": "clients", "integrity_assertions": "client_changes", "processing_jobs": "orders", "disciplines": "nation", "concepts": "items", "terms": "part"}


@query("SELECT 'family' AS kind, brand AS name, count(*) AS n FROM items WHERE brand IS NOT NULL GROUP BY 2 UNION ALL SELECT 'provider', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2 UNION ALL " + " UNION ALL ".join(f"SELECT 'metric', '{k}', {f'(SELECT count(*) FROM {v})' if v else '0'}" for k, v in _TABLES.items()) + " UNION ALL SELECT 'gap', 'problem_representation', 0")
def coverage_tables(t):
    """A snapshot of families, providers, years and thirteen tables, with the gaps of those that are empty."""
    groups = {"family": (t("items"), "brand"), "provider": (t("documents"), "source"), "year": (t("orders").select(F.year("o_orderdate").cast("string").alias("y")), "y")}
    tables = {k: t(v) if v else t("orders").where("o_orderkey < 0") for k, v in _TABLES.items()}
    return ordered.snapshot(groups, tables, {"works": "corpus", "problems": "problem_representation"})


_CHECKS = ("input_representation", "access_model", "state_preparation", "data_loading", "output_readout", "classical_baseline", "dequantization", "end_to_end_complexity", "noise_and_hardware")


@query("""WITH r AS (SELECT s_suppkey AS id, range AS alg, CASE WHEN s_suppkey % 3 > 0 THEN list_transform(range(9), lambda i: (['pass', 'unknown', 'not_applicable', 'unknown', 'pass', 'fail', 'pass'])[(s_suppkey * 5 + range * 3 + i * (1 + s_suppkey % 2)) % (5 + s_suppkey % 3) + 1]) ELSE list_transform(range(9), lambda i: 'unknown') END AS c FROM supplier, range(3))
SELECT id, CAST(alg AS INTEGER) AS alg, list_contains(c, 'fail') AS blocked, CAST(len(list_filter(c, lambda x: x = 'unknown')) AS INTEGER) AS unresolved, array_to_string(list_filter(list_transform(range(9), lambda i: CASE WHEN c[i + 1] = 'fail' THEN (['input_representation', 'access_model', 'state_preparation', 'data_loading', 'output_readout', 'classical_baseline', 'dequantization', 'end_to_end_complexity', 'noise_and_hardware'])[i + 1] END), lambda x: x IS NOT NULL), '|') AS failed FROM r""")
def checklists(t):
    """Nine checks of each pair, unknown where nobody reviewed them, which failed, and whether that blocks the pair."""
    k = F.col("id")
    pairs = t("supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array(*map(F.lit, range(3)))).alias("alg"))
    told = F.array(*map(F.lit, ("pass", "unknown", "not_applicable", "unknown", "pass", "fail", "pass")))
    status = [F.get(told, ((k * 5 + F.col("alg") * 3 + i * (1 + k % 2)) % (5 + k % 3)).cast("int")).alias(c) for i, c in enumerate(_CHECKS)]
    return similarity.checklist(pairs, pairs.where(k % 3 > 0).select("id", "alg", *status), ["id", "alg"], _CHECKS).select("id", "alg", "blocked", "unresolved", F.array_join("failed", "|").alias("failed"))
