"""Citations collected from seeds, round by round, within bounds.

A round takes the first `seeds` nodes of its frontier and, of each, the first `edges` edges a
direction, both in a fixed order; seeds are taken up in order until the edges of those
before reach `edges` in all. New ends are the next frontier. A round is a table of its own, so a
walk that was stopped goes on after its last whole round. Only seeds (at most the bound) are sent
to tasks; of a node's edges each task keeps its first ones before they move.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("references", "cited_by")
ROUND = "round int, seed string, place int, direction string, rank int, source string, target string"


def _collected(edges: DataFrame, seeds: DataFrame, number: int, limit: int, directions: tuple[str, ...]) -> DataFrame:
    """seeds(seed, place), edges(source, target, ord) -> rows of a round."""
    of = {"references": ("source", "target"), "cited_by": ("target", "source")}
    parts = [edges.join(F.broadcast(seeds), F.col(of[d][0]) == F.col("seed")).select("seed", "place", F.lit(d).alias("direction"), F.lit(i).alias("_d"), "source", "target", "ord") for i, d in enumerate(directions)]
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = Window.partitionBy("seed", "direction").orderBy("ord", "source", "target")
    kept = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    # at most `seeds` rows
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("place").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).where(F.col("before") < limit)
    return kept.join(F.broadcast(sizes.select("place")), "place").select(F.lit(number).alias("round"), "seed", "place", "direction", "rank", "source", "target")


def expand(edges: DataFrame, seeds: DataFrame, folder: str, seed_limit: int, edge_limit: int, rounds: int = 1, directions: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """edges(source, target, ord), seeds(id, ord), ids as text -> round, seed, place, direction, rank, source, target.

    Rounds that `folder` holds are not run again. Null ends are no edges; repeated edges count as
    often as they come; a node that was a seed or an end once is no seed again.
    """
    spark = edges.sparkSession
    edges = edges.where("source IS NOT NULL AND target IS NOT NULL")
    order = Window.orderBy("ord", "id")
    frontier = seeds.where("id IS NOT NULL").groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord", "id").limit(seed_limit)
    seen = frontier.select("id")
    try:
        whole = {r.round for r in spark.read.schema("round int").parquet(f"{folder}/done").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = set()
    for number in range(rounds):
        at = f"{folder}/round-{number}"
        own = frontier.select(F.col("id").alias("seed"), (F.row_number().over(order) - 1).alias("place"))
        if number not in whole:  # a round that was stopped halfway is written anew
            _collected(edges, own, number, edge_limit, directions).write.mode("overwrite").parquet(at)
            spark.createDataFrame([(number,)], "round int").coalesce(1).write.mode("append").parquet(f"{folder}/done")
        done = spark.read.schema(ROUND).parquet(at)
        out = done if number == 0 else out.unionByName(done)
        ends = done.select(F.when(F.col("direction") == "references", F.col("target")).otherwise(F.col("source")).alias("id"), F.struct("place", "direction", "rank").alias("ord"))
        # ends are at most twice `seed_limit` times `edge_limit`
        frontier = ends.groupBy("id").agg(F.min("ord").alias("ord")).join(seen, "id", "left_anti").orderBy("ord", "id").limit(seed_limit)
        seen = seen.unionByName(ends.select("id")).distinct()
        if number + 1 < rounds and frontier.isEmpty():
            break
    return out
