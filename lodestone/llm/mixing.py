"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source gets a target of words (water-filling under a cap). Targets are cut
into equal blocks of words; blocks go to sources, and inside a source to its
shards, by the highest quotients target / (2 j - 1). A shard lays its documents
end to end in a seeded order, and its quota of blocks is read off that stream,
which starts anew at its end; so a document is taken whole, in part or twice.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own and comes last; doc_id ties and repeated rows are laid out in
any fixed order; an empty table gives an empty result; columns of the input
other than doc_id, source and text (or size) don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cut import cut, small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sized(source, size) -> key, source, source_size, target, rank; one row for each source.

    The budget is shared by weight; a source above cap times its size is set to
    that cap and the excess is shared again by weight, until none is above. Equal
    to: order sources by cap / weight, and let the level rise past each in turn.
    Windows below run over one row for each source, after aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % k + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in that order, whose limit lies above the level sets the level for all from there on
    per = per.withColumn("final", F.min(F.when(F.col("limit") > F.col("level") * F.col("w"), F.struct(F.col("limit") / F.col("w"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull() | (F.col("limit") <= F.col("final") * F.col("w")), F.col("limit")).otherwise(F.col("final") * F.col("w"))
    return per.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source", "source_size", target.alias("target"), "rank")


def apportion(claims: DataFrame, group: str, claim: str, order: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each row by Sainte-Lague within `group`, ties to the smaller `order`.

    Seats that any divisor near claim-sum / seats gives are set at once; only the
    few quotients around the last seat (at most some three for each row) are ranked.
    """
    g = Window.partitionBy(group)
    near = claims.withColumn("_n", F.count("*").over(g)).withColumn("_q", F.when(F.sum(claim).over(g) > 0, F.col(claim) / F.sum(claim).over(g) * F.col(seats)).otherwise(0.0))
    slack = (F.col("_n") / 2 + 1) / F.greatest(F.col(seats), F.lit(1))
    near = near.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - slack) + 0.5))).withColumn("_hi", F.floor(F.col("_q") * (1 + slack) + 1.5))
    near = near.withColumn("_left", F.col(seats) - F.sum("_lo").over(g))
    j = near.where(f"{claim} > 0").select(group, order, "_left", claim, F.explode(F.expr("sequence(_lo + 1, _hi)")).alias("_j"))
    best = Window.partitionBy(group).orderBy((F.col(claim) / (2 * F.col("_j") - 1)).desc(), order)
    won = j.withColumn("_r", F.row_number().over(best)).where("_r <= _left").groupBy(group, order).agg(F.count("*").alias("_won"))
    return near.join(won, [group, order], "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop("_n", "_q", "_lo", "_hi", "_left", "_won")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block: int = 32, shard_words: int = 65536, max_shards: int = 4096, seed: str = "mix") -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, size, source_size, target, taken, source_rank, shard, quota.

    A source has one shard for each shard_words words, so a hot source is spread
    over many tasks; only (doc_id, source, size) is shuffled, never a text.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = cut(source_targets(sized, weights, budget, cap).withColumn("n_shards", F.expr(f"cast(least({max_shards}, greatest(1, ceil(source_size / {shard_words}))) as int)")))
    # seats: all whole blocks of all targets; the one group holds a row for each source
    seats = targets.withColumn("one", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long"))
    blocks = apportion(seats, "one", "target", "rank", "seats").select("key", "source_size", "target", "rank", "n_shards", F.col("quota").alias("blocks"))
    dealt = sized.select("doc_id", "size", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("seeded"))
    blocks = cut(blocks)
    # a source may hold a third of all rows: a small table goes to every task, a large one is met by key and dealt anew
    dealt = dealt.join(F.broadcast(blocks), "key") if small(blocks, 8 << 20) else dealt.join(blocks, "key").repartition("key", "seeded")
    dealt = dealt.withColumn("shard", (F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long") % F.col("n_shards")).cast("int"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    quotas = apportion(shards, "key", "words", "shard", "blocks").select("key", "shard", "words", "quota")
    stream = Window.partitionBy("key", "shard").orderBy("seeded", "doc_id")
    d = dealt.withColumn("at", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(quotas, ["key", "shard"]).withColumn("words_taken", F.least(F.col("quota") * block, (F.col("words") * F.lit(float(cap))).cast("long")))
    rounds = F.expr("CASE WHEN words > 0 THEN words_taken DIV words ELSE 0 END")
    rest = F.col("words_taken") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return d.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("rank").alias("source_rank"), "shard", "quota")
