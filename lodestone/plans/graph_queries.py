"""Graph, similarity, index and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sets, text
from ..operators import coverage, graph, index, similarity, threshold_join
from .lineage import cut, spread
from .registry import query

#: benchmark items as records: the task is the number of words modulo 6, views are words by length
RECORDS = r"""
w AS (SELECT item_id AS id, regexp_extract_all(text, '[A-Za-z]+') AS a FROM benchmark),
lw AS (SELECT id, len(a) AS n, list_transform(a, lambda x: lower(x)) AS a FROM w),
rec AS (SELECT id, 't' || CAST(n % 6 AS VARCHAR) AS task, CASE WHEN n % 2 = 0 THEN 'yes' ELSE 'no' END AS stochastic,
  list_distinct(list_filter(a, lambda x: len(x) = 5)) AS math, list_distinct(list_filter(a, lambda x: len(x) = 4)) AS operator,
  list_distinct(list_filter(a, lambda x: len(x) = 6)) AS "constraint", list_distinct(list_filter(a, lambda x: len(x) = 7)) AS topology,
  list_distinct(list_filter(a, lambda x: len(x) = 3)) AS method,
  list_filter(list_distinct(list_filter(a, lambda x: len(x) >= 3)), lambda x: x NOT IN ('and','for','from','that','the','this','with')) AS lexical FROM lw)"""
JAC = "CASE WHEN len(list_distinct(list_concat(l.{0}, r.{0}))) > 0 THEN len(list_intersect(l.{0}, r.{0})) / len(list_distinct(list_concat(l.{0}, r.{0})))::DOUBLE ELSE 0 END AS {1}"
SCORED = RECORDS + ", sc AS (SELECT l.id AS left_id, r.id AS right_id, l.task AS lt, r.task AS rt, CASE WHEN l.task = r.task THEN 1.0::DOUBLE ELSE 0 END AS task, CASE WHEN l.stochastic = r.stochastic THEN 1.0::DOUBLE ELSE 0 END AS stochastic, " + ", ".join(JAC.format('"constraint"' if v == "constraint" else v, f'"{v}"') for v in ("math", "operator", "constraint", "topology", "method", "lexical")) + ' FROM rec l JOIN rec r ON l.id < r.id), st AS (SELECT *, 0.18 * task + 0.22 * math + 0.18 * operator + 0.12 * "constraint" + 0.08 * topology + 0.08 * stochastic + 0.06 * method AS structure FROM sc WHERE task + math + operator + "constraint" + topology + method + lexical > 0)'

#: of the aggregate, for pairs of a run
LEAST = 0.30


def records(t):
    a = F.transform(text.every(F.col("text"), "[A-Za-z]+"), F.lower)
    d = t("benchmark").select(F.col("item_id").alias("id"), a.alias("a"))
    of = lambda n: F.array_distinct(F.filter("a", lambda x: F.length(x) == n))
    return d.select("id", F.concat(F.lit("t"), (F.size("a") % 6).cast("string")).alias("task"), F.when(F.size("a") % 2 == 0, "yes").otherwise("no").alias("stochastic"), of(5).alias("math"), of(4).alias("operator"), of(6).alias("constraint"), of(7).alias("topology"), of(3).alias("method"), F.array_except(F.array_distinct(F.filter("a", lambda x: F.length(x) >= 3)), F.array(*map(F.lit, text.STOP))).alias("lexical"))


def scored(t):
    return similarity.score_pairs(records(t)).withColumn("structure", similarity.structural())


@query("SELECT a.l_orderkey AS left_id, b.l_orderkey AS right_id, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2")
def bibliographic_coupling(t):
    """Pairs of orders by shared parts."""
    return graph.shared_neighbours(t("lineitem"), "l_orderkey", "l_partkey")


@query("SELECT a.l_partkey AS left_id, b.l_partkey AS right_id, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def co_citation(t):
    """Pairs of parts by orders that hold both."""
    return graph.shared_neighbours(t("lineitem"), "l_partkey", "l_orderkey")


@query("WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def graph_degrees(t):
    """Distinct neighbours of every node."""
    return graph.degrees(t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))


@query()
def all_components(t):
    """Components of all orders and parts. No SQL: the recursive form is quadratic in a component.

    Nodes go as numbers, even ones orders, odd ones parts. Of a component's numbers of one kind, sign and length the
    nearest to 0 is the first as text too, so its label is the least of these few.
    """
    number = F.col("node").bitwiseAND(1)
    key = lambda n: F.shiftright(n, 1)
    named = lambda n: F.concat(F.when(n.bitwiseAND(1) == 0, "o").otherwise("p"), key(n).cast("string"))
    c = cut(graph.components(t("lineitem").select((F.col("l_orderkey").cast("long") * 2).alias("a"), (F.col("l_partkey").cast("long") * 2 + 1).alias("b"))))
    size = c.groupBy("label", number.alias("kind"), F.length(key(F.col("node")).cast("string")).alias("length"), (F.col("node") < 0).alias("sign"))
    # beyond -1 the greatest is nearest to 0
    few = size.agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"))
    label = cut(few.groupBy("label").agg(F.min(named(F.when(F.col("sign"), F.col("hi")).otherwise(F.col("lo")))).alias("name"), F.sum("n").alias("n")))
    return spread(c, label, ["label"], "n", "node").select(named(F.col("node")).alias("node"), F.col("name").alias("label"))


@query("WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), r AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT e.id, r.depth + 1 FROM e JOIN r ON e.parent_id = r.id) SELECT id, CAST(depth AS INTEGER) AS depth FROM r")
def hierarchy_closure(t):
    """All below one region, breadth first."""
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    root = t("region").where("r_regionkey = 1").select(F.lit("r1").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    return graph.descendants(n.unionByName(c).unionByName(root), "r1")


@query("WITH " + SCORED + ' SELECT left_id, right_id, round(structure, 6) AS structure, round(lexical, 6) AS lexical FROM st')
def pair_similarity(t):
    """Scores of all pairs that share anything."""
    return scored(t).select("left_id", "right_id", F.round("structure", 6).alias("structure"), F.round("lexical", 6).alias("lexical"))


@query("WITH RECURSIVE " + SCORED + ", e AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM st WHERE structure >= 0.3 UNION ALL SELECT right_id, left_id FROM st WHERE structure >= 0.3), r AS (SELECT item_id AS id, item_id AS reached FROM benchmark UNION SELECT e.a, r.reached FROM r JOIN e ON e.b = r.id), c AS (SELECT id, min(reached) AS component FROM r GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS members FROM c")
def threshold_components(t):
    """Components of pairs above a threshold, single ones kept; kinds of records meet at their rarest tokens."""
    return threshold_join.classes_above(records(t), *similarity.weights(similarity.STRUCTURAL), 0.3)


_EMB = """t AS (SELECT item_id AS id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z][A-Za-z0-9_-]{1,}')) AS t FROM benchmark), h AS (SELECT id, sha256(t) AS h FROM t),
v AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS idx, sum(CASE WHEN CAST('0x' || substr(h, 10, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2),
u AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM v WHERE v <> 0), dot AS (SELECT a.id AS left_id, b.id AS right_id, sum(a.v * b.v) AS d FROM u a JOIN u b ON a.idx = b.idx AND a.id < b.id GROUP BY 1, 2)"""


@query("WITH " + SCORED + f""", {_EMB}, ag AS (SELECT left_id, right_id, structure, lexical, least(1, greatest(0, (coalesce(d, 0) + 1) / 2)) AS semantic, 0.14 * task + 0.20 * math + 0.15 * operator + 0.10 * "constraint" + 0.08 * topology + 0.07 * stochastic + 0.06 * method AS base FROM st LEFT JOIN dot USING (left_id, right_id))
SELECT left_id, right_id, round(base + 0.07 * semantic - 0.03 * lexical, 6) AS aggregate, round(structure, 6) AS structure, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, 'structural+lexical+semantic' AS method FROM ag WHERE base + 0.07 * semantic - 0.03 * lexical >= {LEAST}""")
def similarity_run(t):
    """Pairs whose aggregate with the semantic view reaches a bound, found without comparing all pairs."""
    weights, flags = similarity.weights(similarity.AGGREGATE)
    d = threshold_join.pairs_above(records(t), weights, flags, LEAST, similarity.AGGREGATE["semantic"], also=("lexical",))
    d = threshold_join.with_semantic(d, index.hashing_embedding(t("benchmark").select(F.col("item_id").alias("id"), "text")))
    d = d.withColumns({"complexity": F.lit(0.0), "citation": F.lit(0.0)}).withColumns({"aggregate": similarity.aggregate(), "structure": similarity.structural()}).where(F.col("aggregate") >= LEAST)
    return d.select("left_id", "right_id", *[F.round(c, 6).alias(c) for c in ("aggregate", "structure", "semantic", "lexical")], F.lit("structural+lexical+semantic").alias("method"))


@query("WITH " + RECORDS + ", m AS (SELECT task AS component, id, unnest(operator) AS token FROM rec), s AS (SELECT task AS component, count(DISTINCT id) AS size FROM rec WHERE len(operator) > 0 GROUP BY 1) SELECT component, token, count(*) AS n, count(DISTINCT id) = any_value(size) AS in_all FROM m JOIN s USING (component) GROUP BY component, token HAVING count(*) >= 2")
def family_features(t):
    """Tokens that a family shares, and those that all its members have."""
    return coverage.stratum_family(records(t).select(F.col("task").alias("component"), "id", F.explode("operator").alias("token")))


@query("WITH " + RECORDS + " SELECT id, array_to_string(list_sort(math), '|') AS math, array_to_string(list_sort(operator), '|') AS operator FROM rec")
def problem_signature(t):
    """Sorted distinct lower-case tokens of each view."""
    return records(t).select("id", F.array_join(F.array_sort("math"), "|").alias("math"), F.array_join(F.array_sort("operator"), "|").alias("operator"))


@query("""WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct(list_concat([lower(p_brand), lower(p_type)], string_split(lower(p_name), ' ')))) AS t FROM part),
k AS (SELECT id, b, substr(sha1(b || ':' || array_to_string(CASE WHEN len(t) > b THEN list_filter(t, lambda x, i: (i - 1) % 4 = b) ELSE t END, '|')), 1, 16) AS key FROM p, range(4) AS u(b))
SELECT x.id, y.id AS neighbour, count(*) AS shared FROM k x JOIN k y USING (b, key) WHERE x.id <> y.id GROUP BY 1, 2 HAVING count(*) >= 3""")
def signature_bucket_neighbors(t):
    """Parts that share three band keys or more."""
    tokens = F.concat(F.array(F.lower("p_brand"), F.lower("p_type")), F.split(F.lower("p_name"), " "))
    return index.bucket_neighbours(t("part").select(F.col("p_partkey").alias("id"), tokens.alias("tokens")), 4, 3)


@query("""WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z][A-Za-z0-9_-]{1,}')) AS t FROM benchmark),
h AS (SELECT id, sha256(t) AS h FROM t), v AS (SELECT id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS INTEGER) AS idx, sum(CASE WHEN CAST('0x' || substr(h, 10, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2 HAVING v <> 0)
SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM v""")
def hashing_embedding(t):
    """Signed hashed token counts at unit length."""
    return index.hashing_embedding(t("benchmark").select(F.col("item_id").alias("id"), "text")).withColumn("value", F.round("value", 6))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS d FROM embeddings, q WHERE vec_id <> 0)
SELECT id, round(least(1, greatest(0, (d + 1) / 2)), 6) AS score FROM s ORDER BY least(1, greatest(0, (d + 1) / 2)) DESC, id LIMIT 10""")
def vector_topk(t):
    """Exact search for the ten nearest of one vector."""
    v = t("embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return index.vector_topk(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 10, 0).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS d FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT query_id, id, round(least(1, greatest(0, (d + 1) / 2)), 12) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= 10""")
def vector_topk_batch(t):
    """Exact search for the ten nearest of every vector whose id is divisible by 20."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return index.vector_topk_batch(v, v.where("id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query("WITH r AS (SELECT source AS provider, doc_id AS work_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pr FROM documents), s AS (SELECT *, 1 / (60.0::DOUBLE + pr) AS score FROM r) SELECT provider, work_id, pr AS provider_rank, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, provider, pr) AS fused_rank FROM s ORDER BY fused_rank LIMIT 1000")
def rank_fusion(t):
    """Reciprocal ranks over sources, best thousand."""
    r = t("documents").select(F.col("source").alias("provider"), F.col("doc_id").alias("work_id"), F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("provider_rank"))
    return index.rank_fusion(r).withColumn("score", F.round("score", 9))


@query("""WITH r AS (SELECT lang AS q, doc_id AS w, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j AS (SELECT lang AS q, doc_id AS w, quality AS rel FROM labels JOIN documents USING (doc_id)),
t AS (SELECT r.q, rank, coalesce(rel, 0) AS rel FROM r LEFT JOIN j ON r.q = j.q AND r.w = j.w WHERE rank <= 20),
o AS (SELECT q, count(*) AS n, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hit, min(CASE WHEN rel > 0 THEN rank END) AS f, sum((2.0 ** rel - 1) / log2(rank + 1.0)) AS dcg FROM t GROUP BY q),
b AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC, w) AS k FROM j),
i AS (SELECT q, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS tot, sum(CASE WHEN k <= 20 THEN (2.0 ** rel - 1) / log2(k + 1.0) ELSE 0 END) AS idcg FROM b GROUP BY q)
SELECT o.q AS query, round(hit / n::DOUBLE, 6) AS precision, round(CASE WHEN tot > 0 THEN hit / tot::DOUBLE ELSE 0 END, 6) AS recall, round(coalesce(1.0 / f, 0), 6) AS mrr, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM o LEFT JOIN i USING (q)""")
def retrieval_metrics(t):
    """Precision, recall, reciprocal rank and nDCG at 20 by language."""
    d = t("documents")
    r = d.select(F.col("lang").alias("query"), F.col("doc_id").alias("work"), F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    j = t("labels").join(d.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("work"), F.col("quality").alias("relevance"))
    m = index.retrieval_metrics(r, j)
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


_SETS = "WITH p AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[A-Za-z]{3,}')) FILTER (role = 'user'))) AS a, list_distinct(flatten(list(regexp_extract_all(text, '[A-Za-z]{3,}')) FILTER (role = 'assistant'))) AS b FROM conversations GROUP BY conv_id), q AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM p), n AS (SELECT conv_id, len(list_intersect(a, b))::DOUBLE AS h, len(a) AS p, len(b) AS g, len(list_distinct(list_concat(a, b))) AS u FROM q), m AS (SELECT conv_id, CASE WHEN p > 0 THEN h / p WHEN g = 0 THEN 1 ELSE 0 END AS precision, CASE WHEN g > 0 THEN h / g WHEN p = 0 THEN 1 ELSE 0 END AS recall, CASE WHEN u > 0 THEN h / u ELSE 1 END AS agreement, CASE WHEN p > 0 THEN h / p ELSE 0.5 END AS overlap FROM n) "


@query(_SETS + "SELECT conv_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(agreement, 6) AS agreement, round(overlap, 6) AS overlap FROM m")
def set_measures(t):
    """Words of the user's turns against the assistant's."""
    words = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, text.every(F.col("text"), "[A-Za-z]{3,}")))))
    d = t("conversations").groupBy("conv_id").agg(words("user").alias("a"), words("assistant").alias("b"))
    p, r, f = sets.precision_recall_f1(F.col("a"), F.col("b"))
    return d.select("conv_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), F.round(sets.jaccard(F.col("a"), F.col("b"), 1.0), 6).alias("agreement"), F.round(sets.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))
