"""Exact dedup: group by a 128-bit content hash, compare bytes in groups, keep the smallest id.

Ids and hashes are written first and counted. Texts are met only where two rows have one
hash: there the text itself is a grouping key, so equal hashes of unlike texts stay
apart, and copies within a task are summed before the shuffle, so a text that a third of
all rows share arrives as one row a task. What returns to the documents is joined on the
hash alone, but for the hashes that two texts share, which are joined on the text as well.

Defined cases: a null text counts as empty; texts that differ only in runs of
whitespace are equal; of repeated rows with one doc_id all are returned; a null
doc_id never wins over a number; an empty table gives an empty result; other columns
of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cut import cut, sent, spread

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    told = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", digest(F.col("norm")))
    # texts are read once for all of this, and once more where two rows have one hash
    rows = cut(told.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    twice = sent(cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")))
    groups = told.join(twice, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # `texts` tells hashes that two texts share
    seen = cut(groups.groupBy("h").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    rows = spread(rows, seen, ["h"], "group_size", "doc_id")
    out = rows.where("texts IS NULL OR texts = 1").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    clash = cut(seen.where("texts > 1").select("h"))
    if not clash.isEmpty():
        again = told.join(sent(clash), "h", "left_semi")
        exact = again.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(again.join(exact, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
