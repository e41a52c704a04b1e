"""Tallies that come with a pass over rows, in place of a second scan: in batches by an observation, in streams by a listener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `faults`: names of the rules that a row breaks, in order; a rule that is null is broken."""
    return df.withColumn("faults", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def tallies(rules: dict[str, Column]) -> list[Column]:
    """total, valid, invalid, and how many rows break each rule."""
    clean = F.size("faults") == 0
    return [F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("valid"), F.count_if(~clean).alias("invalid"), *[F.count_if(F.array_contains("faults", n)).alias(f"broken_{n}") for n in rules]]


def validated(df: DataFrame, rules: dict[str, Column], also: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df with `faults`, and an observation that holds the tallies (and `also`, aggregates) once an action has passed over it all."""
    seen = Observation()
    return checked(df, rules).observe(seen, *tallies(rules), *[c.alias(n) for n, c in (also or {}).items()]), seen


class Audit(StreamingQueryListener):
    """A row for each batch of streams whose observed metrics have this name: run, batch, rows that came in, metrics. Given to `tell` as it comes, kept in `rows` (the last `most`)."""

    def __init__(self, name: str, tell: Callable[[dict], None] | None = None, most: int = 10_000):
        self.name, self.tell, self.most = name, tell, most
        self.rows: list[dict] = []
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name in p.observedMetrics:
            row = {"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, **p.observedMetrics[self.name].asDict()}
            self.rows = [*self.rows, row][-self.most :]
            if self.tell:
                self.tell(row)

    def onQueryTerminated(self, event) -> None:
        self.ended = [*self.ended, event.exception][-self.most :]
