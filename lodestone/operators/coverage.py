"""Coverage reports, priorities and rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold

DIMENSIONS = ("discipline", "decade", "language", "document_type", "provider", "access")
# fixed values: representation priorities of assets, and of those not named
PRIORITY = {"jats": 100, "xml": 90, "tei": 90, "tex": 85, "latex": 85, "source": 80, "html": 70, "text": 60, "plain_text": 60, "abstract": 50, "pdf": 10, "landing_page": 0}
OTHER = 20
# fixed values: the least priority that a part of the MIME type gives, the first that fits
MIME = (("jats", 100), ("tei", 90), ("tex", 85), ("html", 70))


def strata(records: DataFrame) -> DataFrame:
    """Counts of each full stratum, provider, decade and missing dimension, in one pass over grouping sets, and warnings; null and empty are unknown."""
    d = records.select(*[F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in DIMENSIONS])
    dims = [F.col(c) for c in DIMENSIONS]
    sets = d.groupingSets([dims, [F.col("provider")], [F.col("decade")]], *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 0, "stratum").when(F.col("provider").isNotNull(), "provider").otherwise("decade")
    counts = sets.select(kind.alias("kind"), F.when(F.col("g") == 0, F.concat_ws("|", *DIMENSIONS)).otherwise(F.coalesce("provider", "decade")).alias("value"), "n")
    missing = d.agg(F.count("*").alias("all"), *[F.count_if(F.col(c) == "unknown").alias(c) for c in DIMENSIONS])
    row = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), n.alias("n"))
    # fixed values: shares beyond which a dimension's gaps are warned of
    warn = [row("warning", c, F.when(F.col(c) > F.col("all") * share, F.col(c)).otherwise(0)) for c, share in (("provider", 0.10), ("decade", 0.20))]
    told = missing.select(F.explode(F.array(*[row("missing", c, F.col(c)) for c in DIMENSIONS], *warn)).alias("x")).select("x.*")
    return counts.unionByName(told.where("n > 0"))


def priority(u: Column, n: Column, g: Column, h: Column, d: Column) -> tuple[Column, Column]:
    """The clamped weighted score, and the reasons at 0.5 or more, in their order."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.30 * u + 0.25 * n + 0.30 * g + 0.10 * h + 0.05 * d))
    # fixed values: the reasons
    named = [("large coverage gap", g), ("high uncertainty", u), ("high recent novelty", n), ("historical terminology/decade gap", h)]
    return score, F.array_join(F.array_compact(F.array(*[F.when(c >= 0.5, F.lit(k)) for k, c in named])), ",")


def feedback(saturated: Column, unknown_terms: Column, history: Column, gap: Column, disagreement: Column) -> Column:
    """What to do next; history, gap and disagreement are those of the first priority, null if there is none."""
    top = F.when(history >= 0.6, "target_history").when((gap >= 0.6) & (disagreement >= 0.3), "add_provider").otherwise("continue")
    return F.when(saturated, "saturated").when(unknown_terms > 0, "expand_terms").when(gap.isNotNull(), top).otherwise("review_gap")


def decide(availability: Column, permission: Column) -> Column:
    """Whether an action is allowed, and why."""
    return F.when(availability != "retrievable", "not_retrievable").when(permission.isNull(), "rights_unknown").when(permission != "allowed", "not_permitted").otherwise("allowed")


def asset_rank(representation: Column, mime: Column | None = None) -> Column:
    """The priority of a representation by its whole name, raised by the MIME type."""
    r, m = F.lower(representation), F.lower(F.coalesce(F.lit("") if mime is None else mime, F.lit("")))
    own = F.lit(OTHER)
    for k, v in PRIORITY.items():
        own = F.when(r == k, v).otherwise(own)
    raised = F.when(m.startswith("text/"), 60).otherwise(0)
    for part, v in reversed(MIME):
        raised = F.when(F.contains(m, F.lit(part)), v).otherwise(raised)
    return F.greatest(own, raised)


def rank_assets(assets: DataFrame, retention: bool = True) -> DataFrame:
    """assets(id, availability, tdm, retention, representation, mime) -> id, score: those that may be mined (and kept), best first."""
    may = lambda c: decide(F.col("availability"), F.col(c)) == "allowed"
    free = assets.where(may("tdm") & (may("retention") if retention else F.lit(True)))
    return free.select("id", asset_rank(F.col("representation"), F.col("mime")).alias("score")).orderBy(F.col("score").desc(), "id")


def stratum_family(members: DataFrame, least: int = 2) -> DataFrame:
    """members(component, id, token) -> tokens that occur `least` times in a component, and whether all members have them."""
    size = members.groupBy("component").agg(F.count_distinct("id").alias("size"))
    t = members.groupBy("component", "token").agg(F.count("*").alias("n"), F.count_distinct("id").alias("have")).where(F.col("n") >= least)
    return t.join(size, "component").select("component", "token", "n", (F.col("have") == F.col("size")).alias("in_all"))


def families(members: DataFrame, least: int = 2) -> DataFrame:
    """members(component, id, task, operations, structures) -> component, members, dominant_task, task_counts (task:n, by task), shared_operations, shared_structures.

    The dominant task is the commonest, of ties the one seen first in order of id. A token
    is shared if it occurs `least` times, repeats within a member included; tokens are folded.
    """
    tasks = members.groupBy("component", "task").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    told = tasks.groupBy("component").agg(F.sum("n").alias("members"), F.min(F.struct(-F.col("n"), "first", "task")).alias("top"), F.array_sort(F.collect_list(F.concat_ws(":", "task", "n"))).alias("task_counts"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.array().cast("array<string>")).alias("tokens")) for k in ("operations", "structures")])
    tokens = members.select("component", F.explode(kinds).alias("x")).select("component", "x.kind", F.explode("x.tokens").alias("token")).withColumn("token", casefold(F.col("token")))
    shared = tokens.groupBy("component", "kind", "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("token")))).alias(f"shared_{k}")
    own = shared.groupBy("component").agg(listed("operations"), listed("structures"))
    none = F.array().cast("array<string>")
    return told.join(own, "component", "left").select("component", "members", F.col("top.task").alias("dominant_task"), "task_counts", *[F.coalesce(f"shared_{k}", none).alias(f"shared_{k}") for k in ("operations", "structures")])
