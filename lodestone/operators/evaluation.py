"""Scored pairs against what was expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def scored_examples(examples: DataFrame, scores: DataFrame) -> DataFrame:
    """examples(left_id, right_id, expected), scores(left_id, right_id, score) -> expected, score; a pair counts in its own direction, one without a score as 0, one with several by its largest."""
    one = scores.groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    return examples.join(one, ["left_id", "right_id"], "left").select(F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("score", F.lit(0.0)).alias("score"))


def confusion_curve(scored: DataFrame) -> DataFrame:
    """scored(expected, score) -> threshold, tp, fp, tn, fn at each distinct score, as a threshold that is reached.

    Counts by score are ordered by range; each range is summed by itself and takes up the sums
    of the ranges above it, which are one row a range.
    """
    counts = scored.groupBy("score").agg(F.count_if("expected").alias("p"), F.count_if(~F.col("expected")).alias("n"))
    # what the ranges are must not be drawn again, so they are written
    placed = cut(counts.repartitionByRange(F.col("score").desc()).withColumn("range", F.spark_partition_id()))
    here = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("range", F.coalesce(F.sum("rp").over(above), zero).alias("ap"), F.coalesce(F.sum("rn").over(above), zero).alias("an"), F.sum("rp").over(every).alias("all_p"), F.sum("rn").over(every).alias("all_n"))
    d = placed.join(F.broadcast(sums), "range").select("score", (F.sum("p").over(here) + F.col("ap")).alias("tp"), (F.sum("n").over(here) + F.col("an")).alias("fp"), "all_p", "all_n")
    return d.select(F.col("score").alias("threshold"), "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn"))


def confusion_at(scored: DataFrame, threshold: Column | float) -> DataFrame:
    """The four counts at one threshold, in one pass, whether a score has it or not."""
    hit, e = F.col("score") >= threshold, F.col("expected")
    return scored.agg(F.count_if(hit & e).alias("tp"), F.count_if(hit & ~e).alias("fp"), F.count_if(~hit & ~e).alias("tn"), F.count_if(~hit & e).alias("fn"))


def measures(confusion: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall (6 places, 0 over 0 is 0) and evaluated."""
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion.withColumns({"evaluated": tp + fp + tn + fn, "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
