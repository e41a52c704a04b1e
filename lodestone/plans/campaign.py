"""Campaigns: stages whose results are tables, with a ledger of what was done on which inputs.

A stage is known by its name, its parameters and the fingerprints of the stages it reads. One
that the ledger has as completed under its fingerprint is not run again: its table is read. A stage
that fails is recorded and ends the run; the next run goes on from there. A change of
parameters runs that stage and those behind it anew, and leaves what others made.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "stage string, fingerprint string, run long, status string, n long, error string"


@dataclass
class Stage:
    """run(inputs, parameters) -> DataFrame; inputs are the tables of the stages in `reads`."""

    name: str
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    reads: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


@dataclass
class Result:
    run: int
    status: str
    ran: list[str]
    skipped: list[str]
    tables: dict[str, DataFrame]
    error: str | None = None


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def fingerprint(stage: Stage, known: dict[str, str]) -> str:
    told = {"stage": stage.name, "parameters": stage.parameters, "reads": [known[r] for r in stage.reads]}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_campaign(spark: SparkSession, folder: str, stages: list[Stage]) -> Result:
    """The stages in order, each reading only ones before it."""
    past = ledger(spark, folder)
    rows = past.collect()  # a row a stage and run
    done = {(r.stage, r.fingerprint) for r in rows if r.status == "completed"}
    run = max((r.run for r in rows), default=0) + 1
    known: dict[str, str] = {}
    out = Result(run, "completed", [], [], {})

    def say(stage: Stage, status: str, n: int | None, error: str | None) -> None:
        spark.createDataFrame([(stage.name, known[stage.name], run, status, n, error)], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")

    for stage in stages:
        if missing := [r for r in stage.reads if r not in known]:
            raise ValueError(f"stage {stage.name!r} reads {missing}, which no stage before it makes")
        known[stage.name] = fingerprint(stage, known)
        at = f"{folder}/tables/{stage.name}/{known[stage.name]}"
        if (stage.name, known[stage.name]) in done:
            out.skipped.append(stage.name)
        else:
            try:
                stage.run({r: out.tables[r] for r in stage.reads}, stage.parameters).write.mode("overwrite").parquet(at)
                say(stage, "completed", spark.read.parquet(at).count(), None)
                out.ran.append(stage.name)
            except Exception as e:  # what a stage raises is its own
                out.status, out.error = "failed", f"{stage.name}:{type(e).__name__}:{str(e).splitlines()[0][:300]}"
                say(stage, "failed", None, out.error)
                return out
        out.tables[stage.name] = spark.read.parquet(at)
    return out


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """stage, fingerprint, status, n: the last word of the ledger on each stage as it was last asked for."""
    last = ledger(spark, folder).groupBy("stage").agg(F.max_by(F.struct("fingerprint", "status", "n", "error"), "run").alias("x"))
    return last.select("stage", "x.*")
