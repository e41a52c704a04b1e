"""Coverage, ordered, merge and matching queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import decade
from ..operators import coverage, ordered
from .registry import query

_COV = "SELECT o_orderstatus AS discipline, coalesce(CAST(year(o_orderdate) // 10 * 10 AS VARCHAR) || 's', 'unknown') AS decade, coalesce(c_mktsegment, 'unknown') AS language, o_orderpriority AS document_type, 'n' || c_nationkey AS provider, 'unknown' AS access FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@query(f"WITH d AS ({_COV}) SELECT 'stratum' AS kind, concat_ws('|', discipline, decade, language, document_type, provider, access) AS value, count(*) AS n FROM d GROUP BY discipline, decade, language, document_type, provider, access UNION ALL SELECT 'provider', provider, count(*) FROM d GROUP BY provider UNION ALL SELECT 'decade', decade, count(*) FROM d GROUP BY decade UNION ALL SELECT 'missing', 'access', count(*) FROM d HAVING count(*) > 0")
def coverage_strata(t):
    """Counts by stratum, provider, decade and missing dimension."""
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return coverage.strata(d.select(F.col("o_orderstatus").alias("discipline"), decade(F.year("o_orderdate")).alias("decade"), F.col("c_mktsegment").alias("language"), F.col("o_orderpriority").alias("document_type"), F.concat(F.lit("n"), "c_nationkey").alias("provider"), F.lit(None).cast("string").alias("access")))


@query("SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS long_docs FROM documents GROUP BY source")
def coverage_snapshot(t):
    """Counts by source."""
    return t("documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


@query("SELECT o_orderpriority AS stage, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY 1")
def queue_stats(t):
    """Statuses of each stage, none left out."""
    d = t("orders").groupBy(F.col("o_orderpriority").alias("stage")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return d.select("stage", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def claim_next(t):
    """the next job by priority, due time and id."""
    return t("orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


_FS = "WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS d FROM events), f AS (SELECT user_id, min(d) AS d FROM e GROUP BY 1), n AS (SELECT d, count(*) AS n FROM f GROUP BY 1), r AS (SELECT d, count(DISTINCT user_id) AS retrieved FROM e GROUP BY 1), x AS (SELECT d, retrieved, coalesce(n, 0) AS new_items FROM r LEFT JOIN n USING (d)) "


def _seen(t):
    return ordered.first_seen(t("events").withColumn("d", F.to_date("ts")), "user_id", "d")


@query(_FS + "SELECT CAST(d AS VARCHAR) AS day, retrieved, new_items, CAST(sum(new_items) OVER (ORDER BY d) AS BIGINT) AS cumulative FROM x")
def first_seen_novelty(t):
    """New and all users by day."""
    return _seen(t).select(F.col("d").cast("string").alias("day"), "retrieved", "new_items", "cumulative")


@query(_FS + ", v AS (SELECT d, new_items / retrieved::DOUBLE AS novelty FROM x) SELECT CAST(d AS VARCHAR) AS day, round(novelty, 6) AS novelty, row_number() OVER (ORDER BY d) >= 3 AND max(novelty) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 0.03 AS saturated FROM v")
def saturation(t):
    """Whether the last three days brought next to nothing new."""
    d = ordered.saturation(_seen(t).withColumnRenamed("d", "iteration"), F.col("new_items") / F.col("retrieved"))
    return d.select(F.col("iteration").cast("string").alias("day"), F.round("novelty", 6).alias("novelty"), "saturated")


@query(_FS + ", v AS (SELECT d, least(1, (new_items + 0.35 * new_items + 0.20 * retrieved * 0.1) / retrieved::DOUBLE) AS novelty, retrieved % 3 <> 0 AS stable FROM x) SELECT CAST(d AS VARCHAR) AS day, round(novelty, 6) AS novelty, stable AND row_number() OVER (ORDER BY d) >= 4 AND max(novelty) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 0.04 AS saturated FROM v")
def audited_saturation(t):
    """The same with weighted novelty, on days whose strata are stable."""
    n = ordered.audited_novelty(F.col("retrieved"), works=F.col("new_items"), terms=F.col("new_items"), citations=F.col("retrieved") * 0.1)
    d = ordered.saturation(_seen(t).withColumnRenamed("d", "iteration"), n, 4, 3, 0.04, F.col("retrieved") % 3 != 0)
    return d.select(F.col("iteration").cast("string").alias("day"), F.round("novelty", 6).alias("novelty"), "saturated")


_PR = "WITH s AS (SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) AS u, avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0 END) AS n, avg(CASE WHEN lang = 'de' THEN 1.0 ELSE 0 END) AS g FROM documents GROUP BY source)"


@query(_PR + " SELECT source, round(least(1, greatest(0, 0.30 * u + 0.25 * n + 0.30 * g + 0.10 * (1 - u))), 6) AS score, concat_ws(',', CASE WHEN g >= 0.5 THEN 'large coverage gap' END, CASE WHEN u >= 0.5 THEN 'high uncertainty' END, CASE WHEN n >= 0.5 THEN 'high recent novelty' END, CASE WHEN 1 - u >= 0.5 THEN 'historical terminology/decade gap' END) AS reasons FROM s")
def retrieval_priority(t):
    """weighted priority and its reasons."""
    share = lambda c: F.avg(c.cast("double"))
    d = t("documents").groupBy("source").agg(share(F.col("lang") == "en").alias("u"), share(F.col("n_chars") > 2000).alias("n"), share(F.col("lang") == "de").alias("g"))
    score, why = coverage.priority(F.col("u"), F.col("n"), F.col("g"), 1 - F.col("u"), F.lit(0.0))
    return d.select("source", F.round(score, 6).alias("score"), why.alias("reasons"))


@query("WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS v, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e FROM events GROUP BY 1) SELECT user_id, CASE WHEN n % 7 = 0 THEN 'saturated' WHEN e % 5 = 0 THEN 'expand_terms' WHEN user_id % 4 = 0 THEN 'review_gap' WHEN n % 10 / 10.0 >= 0.6 THEN 'target_history' WHEN e % 10 / 10.0 >= 0.6 AND n % 3 / 3.0 >= 0.3 THEN 'add_provider' ELSE 'continue' END AS action FROM s")
def feedback_decision(t):
    """What to do next, of each of the branches."""
    d = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    some = lambda c: F.when(F.col("user_id") % 4 != 0, c)
    return d.select("user_id", coverage.feedback(F.col("n") % 7 == 0, F.when(F.col("e") % 5 == 0, 1).otherwise(0), some(F.col("n") % 10 / 10), some(F.col("e") % 10 / 10), some(F.col("n") % 3 / 3)).alias("action"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'not_retrievable' WHEN p_size < 20 THEN 'rights_unknown' WHEN p_size < 30 THEN 'not_permitted' ELSE 'allowed' END AS decision FROM part")
def rights_filter(t):
    """Whether an asset may be fetched, and why not."""
    permission = F.when(F.col("p_size") >= 30, "allowed").when(F.col("p_size") >= 20, "denied")
    return t("part").select("p_partkey", coverage.decide(F.when(F.col("p_size") < 10, "gone").otherwise("retrievable"), permission).alias("decision"))


_REP = "CASE p_partkey % 14 WHEN 0 THEN 'JATS' WHEN 1 THEN 'xml' WHEN 2 THEN 'tei' WHEN 3 THEN 'tex' WHEN 4 THEN 'latex' WHEN 5 THEN 'source' WHEN 6 THEN 'html' WHEN 7 THEN 'text' WHEN 8 THEN 'plain_text' WHEN 9 THEN 'abstract' WHEN 10 THEN 'pdf' WHEN 11 THEN 'landing_page' ELSE 'figure' END"
_MIME = "CASE p_size % 6 WHEN 0 THEN 'application/jats+xml' WHEN 1 THEN 'application/tei+xml' WHEN 2 THEN 'text/html' WHEN 3 THEN 'Text/plain' WHEN 4 THEN 'application/xhtml+html' END"


@query(f"WITH a AS (SELECT p_partkey, p_size, lower({_REP}) AS r, lower(coalesce({_MIME}, '')) AS m FROM part), s AS (SELECT *, CASE r WHEN 'jats' THEN 100 WHEN 'xml' THEN 90 WHEN 'tei' THEN 90 WHEN 'tex' THEN 85 WHEN 'latex' THEN 85 WHEN 'source' THEN 80 WHEN 'html' THEN 70 WHEN 'text' THEN 60 WHEN 'plain_text' THEN 60 WHEN 'abstract' THEN 50 WHEN 'pdf' THEN 10 WHEN 'landing_page' THEN 0 ELSE 20 END AS own, CASE WHEN m LIKE '%jats%' THEN 100 WHEN m LIKE '%tei%' THEN 90 WHEN m LIKE '%tex%' THEN 85 WHEN m LIKE '%html%' THEN 70 WHEN m LIKE 'text/%' THEN 60 ELSE 0 END AS raised FROM a) SELECT p_partkey AS id, CAST(greatest(own, raised) AS INTEGER) AS score FROM s WHERE p_size % 5 <> 0 AND p_size % 7 NOT IN (0, 1) AND p_partkey % 3 <> 0")
def asset_rank(t):
    """Assets that may be mined and kept, by representation and MIME type."""
    permission = lambda n: F.when(F.col("p_size") % 7 == n, "denied").when(F.col("p_partkey") % 3 != 0, "allowed").alias("tdm" if n else "retention")
    d = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "gone").otherwise("retrievable").alias("availability"), permission(1), permission(0), F.expr(_REP).alias("representation"), F.expr(_MIME).alias("mime"))
    return coverage.rank_assets(d)


@query("SELECT o_custkey, max_by(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert_last_wins(t):
    """F8: the last order of each customer."""
    return ordered.keep_best(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, (SELECT max_by(o_totalprice, (o_orderdate, o_orderkey)) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F') AS last_filled FROM orders o GROUP BY o_custkey")
def upsert_keep_nonnull(t):
    """L3: the last value that isn't null."""
    d = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("last_filled"))
    return ordered.upsert_keep(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["last_filled"])


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def insert_if_absent(t):
    """Rows with new keys only."""
    return ordered.insert_absent(t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])


@query("SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL AND s.s_suppkey IS NULL THEN 'unresolved' WHEN c.c_custkey IS NULL OR s.s_suppkey IS NULL THEN 'attached' WHEN c.c_nationkey = s.s_nationkey THEN 'same' ELSE 'conflict' END AS outcome FROM orders LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN supplier s ON o_orderkey = s_suppkey")
def alias_attachment(t):
    """Both ends of an assertion resolved, attached or in conflict."""
    known = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("identifier"), F.col("c_nationkey").alias("work")).unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey").toDF("identifier", "work"))
    a = t("orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("left_id"), F.concat(F.lit("s"), "o_orderkey").alias("right_id"))
    return ordered.attach_aliases(a, known).select("o_orderkey", "outcome")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'unknown' WHEN bool_or(o_orderstatus = 'P') THEN 'attention_required' ELSE 'assertions_present' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def integrity_status(t):
    """The state of all assertions on a work."""
    d = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("risk"))
    return d.select("c_custkey", F.when(F.col("n") == 0, "unknown").when(F.col("risk"), "attention_required").otherwise("assertions_present").alias("status"))


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 500 AS exhausted FROM events")
def budget_exhausted(t):
    """Whether the running cost has reached its cap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", (F.sum("value").over(w) >= 500).alias("exhausted"))


@query("SELECT client_id, click_id, CAST(row_number() OVER w AS BIGINT) AS requests_used, CAST(sum(greatest(0, coalesce(CAST(trunc(value) AS BIGINT), 0))) OVER w AS BIGINT) AS results_seen, row_number() OVER w >= 20 OR sum(greatest(0, coalesce(CAST(trunc(value) AS BIGINT), 0))) OVER w >= 400 AS exhausted FROM (SELECT DISTINCT click_id, client_id, ts, value FROM clicks) WINDOW w AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, value NULLS FIRST ROWS UNBOUNDED PRECEDING)")
def budget_caps(t):
    """Requests, results and cost used after each call of a client, and whether a cap is reached."""
    c = t("clicks").select("click_id", "client_id", "ts", "value").distinct().withColumns({"results": F.col("value").cast("long"), "cost": F.lit(None).cast("double")})
    return ordered.budget(c, "client_id", [F.col("ts").asc_nulls_first(), F.col("click_id").asc_nulls_first(), F.col("value").asc_nulls_first()], 20, 400).select("client_id", "click_id", "requests_used", "results_seen", "exhausted")


@query("SELECT 'segment' AS dimension, coalesce(segment, 'unknown') AS value, count(*) AS n FROM clients GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM clients GROUP BY 2")
def benchmark_summary(t):
    """Rows by each of two columns, in one pass."""
    return ordered.grouped_counts(t("clients"), ["segment", "source"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(t):
    """A field of JSON texts, with its type."""
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id FROM events UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def union_of_ids(t):
    """The distinct union of ids over providers, each made distinct before it is moved."""
    ids = [t("events").select("user_id"), t("orders").select("o_custkey"), t("supplier").select("s_suppkey")]
    return ids[0].distinct().union(ids[1].distinct()).union(ids[2].distinct()).toDF("user_id").distinct()
