"""Ordered analytics: saturation, first sight, keep-best, batches; and merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def saturation(obs: DataFrame, novelty: Column, least: int = 3, window: int = 3, threshold: float = 0.03, stable: Column | None = None) -> DataFrame:
    """Adds novelty and saturated: enough observations, none of the last `window` above the threshold, and strata that are stable, if that is asked for. One row an iteration."""
    w = Window.orderBy("iteration")
    d = obs.withColumn("novelty", novelty)
    done = (F.row_number().over(w) >= max(least, window)) & (F.max("novelty").over(w.rowsBetween(1 - window, 0)) <= threshold)
    return d.withColumn("saturated", done if stable is None else done & stable)


def audited_novelty(retrieved: Column, **new: Column) -> Column:
    weights = {"works": 1.0, "terms": 0.35, "concepts": 0.75, "citations": 0.20, "signatures": 0.90}  # fixed values
    total = sum((weights[k] * c for k, c in new.items()), F.lit(0.0))
    return F.when(retrieved > 0, F.least(F.lit(1.0), total / retrieved)).otherwise(F.lit(0.0))


def first_seen(events: DataFrame, item: str, iteration: str) -> DataFrame:
    """iteration, retrieved, new_items, cumulative: an item is new in its first iteration only. The running sum goes over one row an iteration."""
    first = events.groupBy(item).agg(F.min(iteration).alias(iteration)).groupBy(iteration).agg(F.count("*").alias("new_items"))
    per = events.groupBy(iteration).agg(F.count_distinct(item).alias("retrieved")).join(first, iteration, "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)))
    return per.withColumn("cumulative", F.sum("new_items").over(Window.orderBy(iteration)))


def keep_best(rows: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """Of each key the row that is last by sequence; a maximum, so rows are combined before the shuffle. Rows equal in the sequence should be equal."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(own, F.struct(*sequence)).alias("_row")).select("_row.*")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a place from 0 on over all rows, without one task that holds them: sorted ranges are counted, and each starts where those before it end."""
    d = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    ends = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_at", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return d.withColumn("_own", within).join(F.broadcast(ends.select("_p", "_at")), "_p").withColumn(name, F.col("_at") + F.col("_own")).drop("_p", "_own", "_at")


def batches(clauses: DataFrame, order: list[Column], text: str, size: int = 8, group: str | None = None) -> DataFrame:
    """Ordered clauses in chunks of `size`: offset, n and the OR string."""
    d = clauses.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) if group else numbered(clauses, order, "_i")
    d = d.withColumn("batch", F.floor(F.col("_i") / size))
    keys = [group] if group else []
    return d.groupBy(*keys, "batch").agg(F.min("_i").cast("long").alias("offset"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", text))), lambda x: x[text]), " OR ").alias("rendered"))


def upsert_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key, even by nulls."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_keep(rows: DataFrame, key: list[str], sequence: list[str], values: list[str]) -> DataFrame:
    """Of each key the last value that isn't null, by sequence."""
    last = lambda v: F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*sequence))).alias(v)
    return rows.groupBy(*key).agg(*[last(v) for v in values])


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def attach_aliases(assertions: DataFrame, known: DataFrame) -> DataFrame:
    """assertions(left_id, right_id), known(identifier, work) -> the work an unknown side goes to, or a conflict of two works."""
    l = known.select(F.col("identifier").alias("left_id"), F.col("work").alias("left_work"))
    r = known.select(F.col("identifier").alias("right_id"), F.col("work").alias("right_work"))
    d = assertions.join(l, "left_id", "left").join(r, "right_id", "left")
    outcome = F.when(F.col("left_work").isNull() & F.col("right_work").isNull(), "unresolved").when(F.col("left_work").isNull() | F.col("right_work").isNull(), "attached").when(F.col("left_work") == F.col("right_work"), "same").otherwise("conflict")
    return d.withColumn("outcome", outcome).withColumn("work", F.when(outcome != "conflict", F.coalesce("left_work", "right_work")))


def counts(parts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row of named counts; tables that several counts share are read once for all of them."""
    own: dict[int, list[str]] = {}
    for k, (df, _) in parts.items():
        own.setdefault(id(df), []).append(k)
    out = None
    for names in own.values():
        one = parts[names[0]][0].agg(*[(F.count("*") if parts[k][1] is None else F.count_if(parts[k][1])).alias(k) for k in names])
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(*parts)


def snapshot(groups: dict[str, tuple[DataFrame, str]], tables: dict[str, DataFrame], gaps: dict[str, str]) -> DataFrame:
    """kind, name, n: counts by each group's column (nulls left out), counts of tables, and a gap for each that is empty."""
    told = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n") for kind, (df, c) in groups.items()]
    sizes = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit("metric").alias("kind"), F.lit(name).alias("name"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    empty = F.create_map(*[F.lit(x) for k, v in gaps.items() for x in (k, v)])
    lacks = sizes.where("n = 0").select(F.lit("gap").alias("kind"), empty[F.col("name")].alias("name"), "n").where("name IS NOT NULL")
    out = sizes.unionByName(lacks)
    for d in told:
        out = d.unionByName(out)
    return out


def budget(calls: DataFrame, key: str, order: list[Column], requests: int, results: int, cost: float | None = None) -> DataFrame:
    """calls(key, results, cost, ...) with requests_used, results_seen, cost_used and exhausted after each call of a key, in order: each of the caps that is reached exhausts. What is below 0 or null counts as 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = lambda c, kind: F.sum(F.greatest(F.lit(0).cast(kind), F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)))).over(w)
    d = calls.select("*", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("requests_used"), used("results", "long").alias("results_seen"), used("cost", "double").alias("cost_used"))
    over = (F.col("requests_used") >= requests) | (F.col("results_seen") >= results)
    return d.withColumn("exhausted", over if cost is None else over | (F.col("cost_used") >= cost))


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n: rows by each column by itself, in one pass; null is unknown."""
    d = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns])
    sets = d.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return sets.select(which.alias("dimension"), F.coalesce(*columns).alias("value"), "n")
