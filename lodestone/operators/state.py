"""Tables that change: job queues, citations, works and vocabularies, as merges of an old table with a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_fingerprint, parse_identifier, stable_id

#: keys of the stores, and what a new row does to an old one with its key: replace it, fill its gaps, or nothing; rows of `append` have no key
STORES = {
    "work_version": (("work_id", "label"), "replace"),
    "problem": (("id",), "replace"),
    "asset": (("id",), "keep:work_id"),
    "citation": (("source", "target", "provider"), "fill"),
    "document_intelligence": (("id",), "absent"),
    "quality": (("id",), "absent"),
    "fingerprint": (("id",), "absent"),
    "similarity": (("left_id", "right_id"), "absent"),
    "candidate": (("id",), "replace"),
    "family_member": (("family_id", "member_id"), "absent"),
    "relation": (("subject_type", "subject", "relation", "object_type", "object", "provider"), "replace"),
    "retrieval_run": ((), "append"),
    "retrieval_hit": ((), "append"),
    "http_call": (("request_id",), "replace"),
    "provider_snapshot": (("fingerprint",), "absent"),
    "document": (("id",), "replace"),
    "math_expression": (("id",), "replace"),
    "extraction_run": (("id",), "replace"),
    "match": (("problem_id", "algorithm_id"), "replace"),
    "proposal": (("id",), "replace"),
    "envelope": ((), "append"),
    "integrity": (("subject", "relation", "object", "provider"), "fill"),
    "review": (("id",), "replace"),
    "work_author": (("work_id", "author_id"), "replace"),
    "provenance": (("work_id", "provider", "record"), "absent"),
    "experiment": (("id",), "replace"),
}


def store(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after `new`, as STORES says. Null keys equal each other. Of rows of `new` with one key, which should be equal, one counts."""
    key, how = STORES[name]
    if how == "append":
        return old.unionByName(new)
    one = new.dropDuplicates(list(key))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    o, n = old.alias("o"), one.alias("n")
    if how == "absent":
        return old.unionByName(n.join(o, same(one, old), "left_anti").select(*old.columns))
    if how == "replace":
        return o.join(n, same(old, one), "left_anti").unionByName(one)
    kept = {how.removeprefix("keep:")} if how.startswith("keep:") else set()

    def value(c):
        a, b, there = F.col(f"o.`{c}`"), F.col(f"n.`{c}`"), F.col("n._there")
        if c in key or c in kept:
            return F.when(F.col("o._there"), a).otherwise(b).alias(c)
        return (F.coalesce(b, a) if how == "fill" else F.when(there, b).otherwise(a)).alias(c)

    o, n = old.withColumn("_there", F.lit(True)).alias("o"), one.withColumn("_there", F.lit(True)).alias("n")
    on = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in key]
    return o.join(n, on, "full").select(*[value(c) for c in old.columns])


def sorted_pairs(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """pairs with their two ids in order, as stores of pairs know them."""
    return pairs.withColumns({left: F.least(left, right), right: F.greatest(left, right)})


def content_id(**fields: Column) -> Column:
    """The key of a store that is known by content."""
    return canonical_fingerprint(**fields)


def owned(works: DataFrame, ids: DataFrame, new: DataFrame) -> DataFrame:
    """new(id, identifiers, ...) with `_id`: the old work it is, by its id, else by the first of its identifiers that is known, else its own id."""
    listed = new.select("id", F.posexplode("identifiers").alias("p", "x")).select("id", "p", "x.scheme", "x.value")
    met = listed.join(ids, ["scheme", "value"]).groupBy("id").agg(F.min_by("work_id", "p").alias("_by"))
    known = works.select("id", F.lit(True).alias("_known"))
    told = new.join(known, "id", "left").join(met, "id", "left")
    return told.withColumn("_id", F.when(F.col("_known"), F.col("id")).otherwise(F.coalesce("_by", "id"))).drop("_known", "_by")


def upsert_works(works: DataFrame, ids: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """works(id, ...), ids(work_id, scheme, value), new(id, identifiers array<struct<scheme, value>>, ...) -> (works, ids) after the merge.

    A new work is an old one by its id, else by the first of its identifiers that is known;
    its fields replace the old ones, nulls too. Unknown identifiers are added, known ones stay where they are.
    New works should not share an identifier among themselves: of those that do, each stays. Of new works
    that are one old work, that with the smallest id of its own stays, then by its other columns in their order.
    """
    told = owned(works, ids, new)
    rest = [c for c in works.columns if c != "id"]
    one = told.groupBy("_id").agg(F.min(F.struct("id", *rest)).alias("_one"))
    rows = one.select(*[F.col("_id").alias("id") if c == "id" else F.col(f"_one.{c}").alias(c) for c in works.columns])
    after = works.join(rows.select("id"), "id", "left_anti").unionByName(rows)
    listed = told.select("_id", F.explode("identifiers").alias("x")).select("_id", "x.scheme", "x.value")
    added = listed.join(ids, ["scheme", "value"], "left_anti").groupBy("scheme", "value").agg(F.min("_id").alias("work_id"))
    return after, ids.unionByName(added.select(*ids.columns))


def find_work(asked: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """asked with `work`: what an identifier in any spelling belongs to, null if it parses to none that is known. A pair of scheme and value belongs to its smallest work."""
    owner = ids.groupBy("scheme", "value").agg(F.min("work_id").alias("work"))
    d = asked.withColumn("_x", parse_identifier(F.col(column)))
    on = (F.col("_x.scheme") == owner.scheme) & (F.col("_x.value") == owner.value)
    return d.join(owner, on, "left").drop("_x", "scheme", "value")


def resolve_citations(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges(source, target, ...) with source_work, target_work and canonical: whether both ends are known works."""
    d = find_work(find_work(edges, ids, "source").withColumnRenamed("work", "source_work"), ids, "target").withColumnRenamed("work", "target_work")
    return d.withColumn("canonical", F.col("source_work").isNotNull() & F.col("target_work").isNotNull())


def materialise(external: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """known(source, target, provider, edge_id) after external edges whose ends are known by now joined them; an old edge keeps what the new one lacks."""
    found = resolve_citations(external, ids).where("canonical").select(F.col("source_work").alias("source"), F.col("target_work").alias("target"), "provider", "edge_id")
    one = found.groupBy("source", "target", "provider").agg(F.max("edge_id").alias("edge_id"))
    return store("citation", known, one)


def first_identifier(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """hits(run_id, work_id), ids(row_id, work_id, value) -> run_id, work_id, seed: the first identifier of each work of a run by row, else its own id; hits without a work are left out."""
    first = ids.groupBy("work_id").agg(F.min_by("value", "row_id").alias("seed"))
    return hits.where("work_id IS NOT NULL").select("run_id", "work_id").distinct().join(first, "work_id", "left").withColumn("seed", F.coalesce("seed", F.col("work_id").cast("string")))


def job_id(work: Column, asset: Column, stage: Column) -> Column:
    return stable_id("processing-job", F.concat_ws(":", work, F.coalesce(asset, F.lit("")), stage))


def enqueue(jobs: DataFrame, new: DataFrame, works: DataFrame, now: str) -> DataFrame:
    """jobs after new(work_id, asset_id, stage, priority, max_attempts, available_at, payload): completed and running ones stay as they are, failed and pending ones are reset. A work that is unknown is left out."""
    known = new.join(works.select(F.col("id").alias("work_id")).distinct(), "work_id", "left_semi")
    n = known.withColumn("id", job_id(F.col("work_id"), F.col("asset_id"), F.col("stage"))).dropDuplicates(["id"]).alias("n")
    o = jobs.alias("o")
    stays = F.coalesce(F.col("o.status").isin("completed", "running"), F.lit(False)) | F.col("n.id").isNull()
    due = F.coalesce(F.col("n.available_at"), F.lit(now).cast("timestamp"))
    fresh = {"status": F.lit("pending"), "priority": F.coalesce(F.col("n.priority"), F.lit(0)), "max_attempts": F.coalesce(F.col("n.max_attempts"), F.lit(3)), "available_at": due, "payload": F.coalesce("n.payload", "o.payload"), "error": F.lit(None).cast("string"), "attempts": F.coalesce("o.attempts", F.lit(0)), "claimed_at": F.col("o.claimed_at"), "completed_at": F.col("o.completed_at")}
    own = {c: F.coalesce(f"n.{c}", f"o.{c}") for c in ("id", "work_id", "asset_id", "stage")} | fresh
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(*[F.when(stays, F.col(f"o.{c}")).otherwise(own[c].cast(jobs.schema[c].dataType)).alias(c) for c in jobs.columns])


def claim(jobs: DataFrame, now: str, stages: list[str] | None = None) -> DataFrame:
    """jobs after the next one was claimed: pending, due and with attempts left, by priority, then due time, then id."""
    due = jobs.where(F.col("status") == "pending").where(F.col("available_at") <= F.lit(now).cast("timestamp")).where("attempts < max_attempts")
    due = due.where(F.col("stage").isin(stages)) if stages else due
    first = due.orderBy(F.col("priority").desc(), "available_at", "id").limit(1).select("id", F.lit(True).alias("_own"))
    own = F.coalesce("_own", F.lit(False))
    d = jobs.join(F.broadcast(first), "id", "left")
    after = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now).cast("timestamp"), "error": F.lit(None).cast("string")}
    return d.select(*[F.when(own, after[c].cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in jobs.columns])


def finish(jobs: DataFrame, events: DataFrame, now: str, delay: float = 30.0) -> DataFrame:
    """jobs after events(id, kind, error): `complete`, `fail` (again pending after a delay while attempts are left), `requeue` and `reset` (with attempts from 0)."""
    t = F.lit(now).cast("timestamp")
    d = jobs.alias("o").join(events.select("id", "kind", F.col("error").alias("why")).dropDuplicates(["id"]).alias("e"), "id", "left")
    kind, last = F.coalesce("kind", F.lit("")), F.col("attempts") >= F.col("max_attempts")
    again = kind.isin("requeue", "reset")
    later = t + F.make_dt_interval(secs=F.lit(max(0.0, delay)).cast("decimal(18, 6)"))
    after = {
        "status": F.when(kind == "complete", "completed").when(kind == "fail", F.when(last, "failed").otherwise("pending")).when(again, "pending").otherwise(F.col("status")),
        "attempts": F.when(kind == "reset", 0).otherwise(F.col("attempts")),
        "completed_at": F.when((kind == "complete") | ((kind == "fail") & last), t).when(again, None).otherwise(F.col("completed_at")),
        "claimed_at": F.when(again | ((kind == "fail") & ~last), None).otherwise(F.col("claimed_at")),
        "available_at": F.when((kind == "fail") & ~last, later).when(again, t).otherwise(F.col("available_at")),
        "error": F.when(kind == "fail", F.col("why")).when(kind != "", None).otherwise(F.col("error")),
    }
    return d.select(*[after[c].cast(jobs.schema[c].dataType).alias(c) if c in after else F.col(c) for c in jobs.columns])
