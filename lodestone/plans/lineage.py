"""Cut lineage in the folder that all executors share, deal rows to tasks, broadcast only what is measured to be small, and spread joins on hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENT_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir, which the driver and all executors share.

    A session that names no folder gets one of its own if it runs in one process, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to spark.checkpoint.dir and go on from the written rows, which outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str, each: int = 1 << 15) -> DataFrame:
    """df with its rows dealt to tasks of about `each` of them by their key, at least one a core. For narrow rows that much is made of:
    a file is read in as many tasks as it has row groups, which may be one."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // each + 1), key)


def small(df: DataFrame, limit: int = SENT_BYTES) -> bool:
    """Whether df, measured over all its rows, stays under limit bytes. For tables that are cut."""
    each = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0).cast("long"))
    return (df.agg(F.sum(each)).first()[0] or 0) <= limit


def sent(df: DataFrame, limit: int = SENT_BYTES) -> DataFrame:
    """df to be sent to every task if it is small, else as it is."""
    return F.broadcast(df) if small(df, limit) else df


def spread(left: DataFrame, right: DataFrame, keys: list[str], n: str, by: str, send: bool = True) -> DataFrame:
    """left with the columns of right, null where right, one row a key with its number `n` of rows in left, has none.

    A small right goes to every task, if `send` allows it. Else keys of very many rows are dealt to several tasks:
    those of over `deal`, of which there are at most 250,000, whatever the size of left.
    """
    if send and small(right):
        return left.join(F.broadcast(right), keys, "left")
    total = right.agg(F.sum(n)).first()[0] or 0
    deal = max(1024, total // 250_000)
    parts = F.when(F.col(n) > deal, F.ceil(F.col(n) / deal).cast("int")).otherwise(1)
    hot = right.where(F.col(n) > deal).select(*keys, parts.alias("_parts"))
    # a row of one key goes by its own value and by where it stands, so that repeated rows part too
    part = F.pmod(F.xxhash64(by) + F.spark_partition_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    met = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(met, [*keys, "_part"], "left").drop("_part")
