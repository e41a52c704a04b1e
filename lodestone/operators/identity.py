"""Works that are one by their identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from .graph import components, expanded, packed


def normalized(scheme: Column, value: Column) -> Column:
    """The spelling of an identifier that its scheme makes one: DOIs folded and without resolver, PMCIDs upper case, arXiv ids without prefix."""
    v = F.trim(value)
    return F.when(scheme == "doi", casefold(F.regexp_replace(v, r"(?i)^https?://(dx\.)?doi\.org/", ""))).when(scheme == "pmcid", F.upper(v)).when(scheme == "arxiv", F.regexp_replace(v, "(?i)^arxiv:", "")).otherwise(v)


def identifiers(works: DataFrame) -> DataFrame:
    """works(id, identifiers: array<struct<scheme, value>>) -> id, identifier: scheme:value, distinct; null schemes and values are left out."""
    listed = works.select("id", F.explode("identifiers").alias("i")).select("id", F.concat_ws(":", "i.scheme", normalized(F.col("i.scheme"), F.col("i.value"))).alias("identifier"), (F.col("i.scheme").isNotNull() & F.col("i.value").isNotNull()).alias("ok"))
    return listed.where("ok").drop("ok").distinct()


def same_works(works: DataFrame, block: int = 1024) -> DataFrame:
    """Pairs of works that share an identifier: left_id < right_id, relation, reason (the smallest one shared), confidence.

    A pair is made at its smallest shared identifier alone, in the task that has a pair of packs of about `block` of its
    works, and is not moved: each work brings its smaller identifiers along, those of one work left out, and where
    two share one of them they have met there. `_bits` tells most that share none.
    """
    held = identifiers(works)
    shared = held.groupBy("identifier").agg(F.count("*").alias("n")).where("n > 1").select("identifier")
    held = held.join(shared, "identifier").groupBy("id").agg(F.array_sort(F.collect_set("identifier")).alias("all")).select("id", F.posexplode("all").alias("p", "kind"), "all")
    smaller = F.slice("all", F.lit(1), F.col("p"))
    bits = F.aggregate(smaller, F.lit(0).cast("long"), lambda z, x: z.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    packs = packed(held.select("kind", F.struct("id", bits.alias("_bits"), smaller.alias("smaller")).alias("own")), block)
    at = packs.select(F.col("kind").alias("a"), F.col("kind").alias("b"), F.concat(F.lit("exact identifier agreement on "), "kind").alias("reason")).distinct()
    pairs = expanded(at, packs).where((F.col("x._bits").bitwiseAND(F.col("y._bits")) == 0) | ~F.arrays_overlap("x.smaller", "y.smaller"))
    return pairs.select(F.least("x.id", "y.id").alias("left_id"), F.greatest("x.id", "y.id").alias("right_id"), F.lit("same_work").alias("relation"), "reason", F.lit(1.0).alias("confidence"))


def work_classes(works: DataFrame) -> DataFrame:
    """id, class (the smallest id that a chain of shared identifiers reaches), members. Each work is linked to the first holder of each identifier, so no pairs are made."""
    held = identifiers(works)
    first = held.groupBy("identifier").agg(F.min("id").alias("a"))
    linked = components(held.join(first, "identifier").select("a", F.col("id").alias("b")))
    told = works.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("class"))
    return told.join(told.groupBy("class").agg(F.count("*").alias("members")), "class").select("id", "class", "members")
