"""Queues, citations, works and other stores, as merges over orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, state
from .registry import query

_IDS = "(SELECT c_custkey AS work_id, 'doi' AS scheme, '10.5/c' || c_custkey AS value FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT c_custkey, 'pmid', 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 2)"
#: both ends of an order as identifiers in several spellings, some unknown
_EDGE = "CASE o_custkey % 3 WHEN 2 THEN 'PMID:c' || o_custkey WHEN 1 THEN 'https://doi.org/10.5/C' || o_custkey ELSE 'doi:10.5/c' || o_custkey END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'nothing' ELSE 'doi:10.5/c' || o_orderkey % 200 END AS target"
_ENDS = f"WITH ids AS {_IDS}, e AS (SELECT o_orderkey, o_custkey AS sw, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 200 % 3 <> 2 THEN (SELECT c_custkey FROM customer WHERE c_custkey = o_orderkey % 200) END AS tw, CASE WHEN o_orderkey % 4 = 0 THEN 'e' || o_orderkey END AS edge, 'p' || o_orderkey % 2 AS provider FROM orders)"


def _ids(t):
    c = t("customer").select(F.col("c_custkey").alias("work_id"))
    own = F.concat(F.lit("c"), "work_id")
    return c.select("work_id", F.when(F.col("work_id") % 3 == 2, "pmid").otherwise("doi").alias("scheme"), F.when(F.col("work_id") % 3 == 2, own).otherwise(F.concat(F.lit("10.5/"), own)).alias("value"))


def _edges(t):
    return t("orders").selectExpr("o_orderkey", _EDGE.split(" AS source, ")[0] + " AS source", _EDGE.split(" AS source, ")[1], "'p' || (o_orderkey % 2) AS provider", "CASE WHEN o_orderkey % 4 = 0 THEN 'e' || o_orderkey END AS edge_id")


@query(_ENDS + " SELECT o_orderkey, sw AS source_work, tw AS target_work, tw IS NOT NULL AS canonical FROM e")
def citation_resolution(t):
    """Both ends of an edge by their identifiers; edges with an unknown end stay external."""
    return state.resolve_citations(_edges(t), _ids(t)).select("o_orderkey", "source_work", "target_work", "canonical")


@query(_ENDS + ", n AS (SELECT sw, tw, provider, max(edge) AS edge FROM e WHERE tw IS NOT NULL GROUP BY ALL), k AS (SELECT s_suppkey AS sw, s_suppkey + 1 AS tw, 'p0' AS provider, 'old' AS edge FROM supplier) SELECT coalesce(n.sw, k.sw) AS source, coalesce(n.tw, k.tw) AS target, coalesce(n.provider, k.provider) AS provider, coalesce(n.edge, k.edge) AS edge_id FROM n FULL JOIN k ON n.sw = k.sw AND n.tw = k.tw AND n.provider = k.provider")
def citation_materialise(t):
    """External edges that resolve by now join the known ones; an old edge id stays where the new edge has none."""
    known = t("supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 1).alias("target"), F.lit("p0").alias("provider"), F.lit("old").alias("edge_id"))
    return state.materialise(_edges(t).select("source", "target", "provider", "edge_id"), _ids(t), known)


@query("SELECT DISTINCT o_orderpriority AS run_id, o_custkey AS work_id, CASE WHEN o_custkey % 10 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'a' || o_custkey END AS seed FROM orders WHERE o_orderstatus <> 'P'")
def seed_identifiers(t):
    """Works of a recovered run with their first identifier by row, else their own id."""
    hits = t("orders").select(F.col("o_orderpriority").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("work_id"))
    own = t("customer").where("c_custkey % 10 <> 0")
    ids = own.select((F.col("c_custkey") * 2 + 1).alias("row_id"), F.col("c_custkey").alias("work_id"), F.concat(F.lit("b"), "c_custkey").alias("value")).unionByName(own.select((F.col("c_custkey") * 2).alias("row_id"), F.col("c_custkey").alias("work_id"), F.concat(F.lit("a"), "c_custkey").alias("value")))
    return state.first_identifier(hits, ids)


@query(f"""WITH old AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS lang FROM customer), new AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 100000 + s_suppkey END AS id, s_name AS title, s_suppkey FROM supplier),
i AS {_IDS}, m AS (SELECT CASE WHEN new.id IN (SELECT id FROM old) THEN new.id ELSE coalesce((SELECT min(work_id) FROM i WHERE scheme = 'doi' AND value = '10.5/c' || s_suppkey), new.id) END AS id, title, NULL::VARCHAR AS lang, new.id AS own FROM new)
SELECT id, title, lang FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY own, title) = 1 UNION ALL SELECT id, title, lang FROM old WHERE id NOT IN (SELECT id FROM m)""")
def upsert_works(t):
    """L1: works merged by id, else by their first known identifier; fields are overwritten, by nulls too."""
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("lang"))
    k = F.col("s_suppkey")
    listed = F.array(F.struct(F.lit("doi").alias("scheme"), F.lit("10.5/unknown").alias("value")), F.struct(F.lit("doi").alias("scheme"), F.concat(F.lit("10.5/c"), k).alias("value")))
    new = t("supplier").select(F.when(k % 2 == 0, k).otherwise(100000 + k).alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("lang"), listed.alias("identifiers"))
    return state.upsert_works(old, _ids(t), new)[0]


_OLD = "(SELECT c_custkey AS id, c_nationkey AS work_id, c_mktsegment AS note FROM customer)"
_NEW = "(SELECT s_suppkey * 3 AS id, s_nationkey + 100 AS work_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS note FROM supplier)"


def _old_new(t):
    old = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("work_id"), F.col("c_mktsegment").alias("note"))
    new = t("supplier").select((F.col("s_suppkey") * 3).alias("id"), (F.col("s_nationkey") + 100).alias("work_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("note"))
    return old, new


@query(f"SELECT * FROM {_OLD} o WHERE id NOT IN (SELECT id FROM {_NEW} n) UNION ALL SELECT * FROM {_NEW} n")
def store_replace(t):
    """Rows replaced by key, nulls too, as in the store of problems; the stores with children are in store_queries."""
    return state.store("problem", *_old_new(t))


@query(f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.work_id, n.work_id) AS work_id, CASE WHEN n.id IS NOT NULL THEN n.note ELSE o.note END AS note FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id")
def store_asset(t):
    """L4: assets replaced by id, but for the work that owns them."""
    return state.store("asset", *_old_new(t))


@query(f"SELECT * FROM {_OLD} o UNION ALL SELECT * FROM {_NEW} n WHERE id NOT IN (SELECT id FROM {_OLD} o)")
def store_absent(t):
    """Rows with new keys only, as in the store of quality reports."""
    return state.store("quality", *_old_new(t))


@query(f"SELECT * FROM {_OLD} o UNION ALL SELECT * FROM {_NEW} n")
def store_append(t):
    """Hits are added as they are."""
    return state.store("retrieval_hit", *_old_new(t))


@query("SELECT coalesce(s.k, c.k) AS subject, 'retracts' AS relation, 'x' AS object, 'p' AS provider, coalesce(s.v, c.v) AS note FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) c FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS v FROM supplier) s ON c.k = s.k")
def store_integrity(t):
    """Assertions by key, where a new one fills in or replaces what it has."""
    row = lambda k, v: [F.col(k).alias("subject"), F.lit("retracts").alias("relation"), F.lit("x").alias("object"), F.lit("p").alias("provider"), v.alias("note")]
    return state.store("integrity", t("customer").select(*row("c_custkey", F.col("c_mktsegment"))), t("supplier").select(*row("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))))


NOW = "2020-01-01 00:00:00"
_JOBS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderpriority AS stage, o_custkey % 4 AS priority, o_orderkey % 4 AS attempts, o_orderdate AS available_at FROM orders"


def _jobs(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    none = F.lit(None).cast("string")
    return t("orders").select(k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("work_id"), none.alias("asset_id"), F.col("o_orderpriority").alias("stage"), status.alias("status"), (F.col("o_custkey") % 4).cast("int").alias("priority"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").cast("timestamp").alias("available_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("timestamp").alias("completed_at"), none.alias("payload"), F.when(status == "failed", "broken").alias("error"))


@query(f"WITH j AS ({_JOBS}), c AS (SELECT id FROM j WHERE status = 'pending' AND attempts < 3 AND available_at <= TIMESTAMP '{NOW}' ORDER BY priority DESC, available_at, id LIMIT 1) SELECT j.id, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status, CAST(attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts, c.id IS NOT NULL AS claimed FROM j LEFT JOIN c ON j.id = c.id")
def queue_claim(t):
    """The queue after its next job was claimed."""
    return state.claim(_jobs(t), NOW).select("id", "status", "attempts", F.col("claimed_at").isNotNull().alias("claimed"))


@query(f"""WITH j AS ({_JOBS}), e AS (SELECT *, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'requeue' WHEN 3 THEN 'reset' END AS kind FROM j)
SELECT id, CASE kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN 'requeue' THEN 'pending' WHEN 'reset' THEN 'pending' ELSE status END AS status,
CAST(CASE WHEN kind = 'reset' THEN 0 ELSE attempts END AS INTEGER) AS attempts, CASE WHEN kind = 'fail' THEN 'why' WHEN kind IS NOT NULL THEN NULL WHEN status = 'failed' THEN 'broken' END AS error,
CASE WHEN kind = 'complete' OR (kind = 'fail' AND attempts >= 3) THEN true ELSE false END AS done, strftime(CASE WHEN kind = 'fail' AND attempts < 3 THEN TIMESTAMP '{NOW}' + INTERVAL 30 SECOND WHEN kind IN ('requeue', 'reset') THEN TIMESTAMP '{NOW}' ELSE available_at END, '%Y-%m-%d %H:%M:%S') AS due FROM e""")
def queue_transitions(t):
    """The queue after jobs were completed, failed, or put back."""
    k = F.col("o_orderkey") % 5
    events = t("orders").where("o_orderkey % 5 < 4").select(F.col("o_orderkey").cast("string").alias("id"), F.when(k == 0, "complete").when(k == 1, "fail").when(k == 2, "requeue").otherwise("reset").alias("kind"), F.lit("why").alias("error"))
    d = state.finish(_jobs(t), events, NOW)
    return d.select("id", "status", "attempts", "error", F.col("completed_at").isNotNull().alias("done"), F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("WITH j AS (SELECT o_custkey, o_orderpriority AS stage, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderpriority < '3' GROUP BY ALL), n AS (SELECT c_custkey, '1-URGENT' AS stage FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(j.o_custkey, n.c_custkey) AS work, coalesce(j.stage, n.stage) AS stage, CASE WHEN j.s = 'F' THEN 'completed' WHEN n.c_custkey IS NOT NULL THEN 'pending' WHEN j.s = 'O' THEN 'pending' ELSE 'failed' END AS status, CAST(CASE WHEN j.s = 'F' OR n.c_custkey IS NULL THEN 1 ELSE 9 END AS INTEGER) AS priority FROM j FULL JOIN n ON j.o_custkey = n.c_custkey AND j.stage = n.stage")
def queue_enqueue(t):
    """Jobs asked for anew: completed ones stay, others are reset, unknown works are left out."""
    first = ordered.keep_best(t("orders").where("o_orderpriority < '3'").withColumn("_k", -F.col("o_orderkey")), ["o_custkey", "o_orderpriority"], ["_k"])
    work = F.col("o_custkey").cast("string")
    none = F.lit(None).cast("string")
    jobs = first.select(state.job_id(work, none, F.col("o_orderpriority")).alias("id"), work.alias("work_id"), none.alias("asset_id"), F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"), F.lit(1).alias("priority"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(NOW).cast("timestamp").alias("available_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("timestamp").alias("completed_at"), none.alias("payload"), none.alias("error"))
    c = F.col("c_custkey")
    new = t("customer").select(F.when(c % 2 == 0, c.cast("string")).otherwise(F.concat(F.lit("unknown"), c)).alias("work_id"), none.alias("asset_id"), F.lit("1-URGENT").alias("stage"), F.lit(9).alias("priority"), F.lit(None).cast("int").alias("max_attempts"), F.lit(None).cast("timestamp").alias("available_at"), none.alias("payload"))
    known = t("customer").select(c.cast("string").alias("id"))
    return state.enqueue(jobs, new, known, NOW).select(F.col("work_id").cast("long").alias("work"), "stage", "status", "priority")


@query("SELECT (SELECT count(*) FROM orders) AS provider_requests, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS provider_request_failures, (SELECT count(*) FROM part) AS assets, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lineitem) AS canonical_citations, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS unresolved_citation_assertions, (SELECT count(*) FROM customer) AS identity_assertions, (SELECT count(*) FROM supplier) AS integrity_assertions, (SELECT count(*) FROM pages) AS asset_acquisitions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending_jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed_jobs")
def operational_snapshot(t):
    """Eleven counts over the tables of a run."""
    o = t("orders")
    parts = {"provider_requests": (o, None), "provider_request_failures": (o, F.col("o_orderstatus") == "P"), "assets": (t("part"), None), "documents": (t("documents"), None), "canonical_citations": (t("lineitem"), None), "unresolved_citation_assertions": (o, F.col("o_orderkey") % 5 == 0), "identity_assertions": (t("customer"), None), "integrity_assertions": (t("supplier"), None), "asset_acquisitions": (t("pages"), None), "pending_jobs": (o, F.col("o_orderstatus") == "O"), "failed_jobs": (o, F.col("o_orderstatus") == "F")}
    return ordered.counts(parts)


@query("SELECT 'family' AS kind, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'provider', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2 UNION ALL SELECT 'metric', 'works', count(*) FROM orders UNION ALL SELECT 'metric', 'problems', 0 UNION ALL SELECT 'gap', 'problem_representation', 0")
def corpus_snapshot(t):
    """Families, providers and years, counts of tables, and the tables that are empty."""
    return ordered.snapshot({"family": (t("orders"), "o_orderpriority"), "provider": (t("documents"), "source"), "year": (t("orders").select(F.year("o_orderdate").cast("string").alias("y")), "y")}, {"works": t("orders"), "problems": t("orders").where("false")}, {"works": "corpus", "problems": "problem_representation"})


@query("SELECT user_id AS provider, max_by(event_id, ts) AS event_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def latest_snapshot(t):
    """F8: the last snapshot of each provider."""
    e = t("events")
    last = ordered.keep_best(e, ["user_id"], ["ts"])
    return last.join(e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")), "user_id").select(F.col("user_id").alias("provider"), "event_id", "kinds")
