"""Queries that run a stream over the tables, each part of it from the checkpoint of the part before."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import jobs
from .lineage import shared_folder
from .registry import query

#: orders are fed in three parts, by date
PARTS = ("1995-01-01", "1997-01-01")
_KINDS = ("enqueue", "claim", "fail", "claim", "complete", "requeue", "claim", "fail", "reset")
_KIND = "(" + "[" + ", ".join(f"'{k}'" for k in _KINDS) + "])[o_orderkey % 9 + 1]"
_STATUS = """CASE e.kind WHEN 'enqueue' THEN CASE WHEN s.status IN ('completed', 'running') THEN s.status ELSE 'pending' END WHEN 'claim' THEN CASE WHEN ok THEN 'running' ELSE s.status END
  WHEN 'complete' THEN 'completed' WHEN 'fail' THEN CASE WHEN s.attempts >= s.most THEN 'failed' ELSE 'pending' END ELSE 'pending' END"""


@query(f"""WITH RECURSIVE e AS (SELECT o_custkey AS id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS at, {_KIND} AS kind, CAST(o_orderkey % 4 AS INTEGER) AS most, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
s AS (SELECT DISTINCT id, 0::BIGINT AS n, NULL::VARCHAR AS status, 0 AS attempts, NULL::INTEGER AS most, NULL::BIGINT AS due, NULL::BIGINT AS claimed, NULL::BIGINT AS done, NULL::VARCHAR AS error FROM e
 UNION ALL SELECT s.id, e.n, CASE WHEN idle THEN NULL ELSE {_STATUS} END, CASE WHEN idle THEN 0 WHEN e.kind = 'claim' AND ok THEN s.attempts + 1 WHEN e.kind = 'reset' THEN 0 ELSE s.attempts END,
   CASE WHEN e.kind = 'enqueue' AND NOT held THEN e.most ELSE s.most END,
   CASE WHEN idle THEN NULL WHEN (e.kind = 'enqueue' AND NOT held) OR e.kind IN ('requeue', 'reset') THEN e.at WHEN e.kind = 'fail' AND s.attempts < s.most THEN e.at + 7776000000 ELSE s.due END,
   CASE WHEN e.kind = 'claim' AND ok THEN e.at WHEN (e.kind = 'fail' AND s.attempts < s.most) OR e.kind IN ('requeue', 'reset') THEN NULL ELSE s.claimed END,
   CASE WHEN idle THEN NULL WHEN e.kind = 'complete' OR (e.kind = 'fail' AND s.attempts >= s.most) THEN e.at WHEN e.kind IN ('requeue', 'reset') THEN NULL ELSE s.done END,
   CASE WHEN idle THEN NULL WHEN e.kind = 'fail' THEN 'broken' WHEN (e.kind = 'enqueue' AND held) OR (e.kind = 'claim' AND NOT ok) THEN s.error ELSE NULL END
 FROM (SELECT s.*, e.at AS now, s.status = 'pending' AND s.due <= e.at AND s.attempts < s.most AS ok, coalesce(s.status IN ('completed', 'running'), false) AS held, s.status IS NULL AND e.kind <> 'enqueue' AS idle FROM s JOIN e ON e.id = s.id AND e.n = s.n + 1) s JOIN e ON e.id = s.id AND e.n = s.n + 1)
SELECT id, status, attempts, most AS max_attempts, due AS available_at, claimed AS claimed_at, done AS completed_at, error FROM s WHERE status IS NOT NULL QUALIFY n = max(n) OVER (PARTITION BY id)""")
def job_stream(t):
    """Jobs of customers, driven by their orders through a stream of three runs on one checkpoint; a failed job waits 90 days."""
    orders = t("orders")
    spark = orders.sparkSession
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 9).cast("int"))
    none = F.lit(None)
    events = orders.select(F.col("o_custkey").cast("string").alias("id"), kind.alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("seq"), none.cast("timestamp").alias("due"), none.cast("int").alias("priority"), (F.col("o_orderkey") % 4).cast("int").alias("max_attempts"), F.lit("broken").alias("error"))
    top = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    bounds = [None, *PARTS, None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = events.where(F.lit(True) if low is None else F.col("at") >= low).where(F.lit(True) if high is None else F.col("at") < high)
        part.write.mode("append").parquet(f"{top}/in")
        jobs.run_jobs(spark.readStream.schema(events.schema).parquet(f"{top}/in"), f"{top}/out", f"{top}/state", 90 * 86400.0)
    return jobs.jobs(spark, f"{top}/out").select(F.col("id").cast("long").alias("id"), "status", "attempts", "max_attempts", "available_at", "claimed_at", "completed_at", "error")
