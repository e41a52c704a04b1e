"""Runs of several steps: ordered stages, ensembles of extractors, proposals and their evaluation, analysis and ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold, collapse
from ..operators import coverage, records, similarity
from ..operators.ordered import audited_novelty, keep_best, saturation
from ..sources import documents as parsers


class Runner:
    """Stages in order: each gives its own name and a status, and a failed one ends the run."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Callable[[], tuple[str, str]]]] = []

    def add(self, name: str, run: Callable[[], tuple[str, str]]) -> Runner:
        self.stages.append((name, run))
        return self

    def run(self) -> list[tuple[str, str]]:
        out = []
        for name, run in self.stages:
            told, status = run()
            if told != name:
                raise ValueError(f"stage {name!r} gave the result of {told!r}")
            out.append((told, status))
            if status == "failed":
                break
        return out


def iteration(status: str, event: str, action: str | None = None) -> str:
    """The next status of an iteration: planned, running, then saturated or completed by the feedback."""
    if event == "start":
        return "running"
    if event == "finish":
        return "saturated" if action == "saturated" else "completed"
    raise ValueError(f"no event {event!r} for an iteration that is {status}")


def require_boundary(kind: str, fixtures: bool = True) -> None:
    """Sources are reached through a gateway; fixtures may stand in for one in tests."""
    if kind != "gateway" and not (fixtures and kind == "fixture"):
        raise PermissionError(f"a source of kind {kind!r} is not reached through a gateway")


def ensemble(extractors: dict[str, Callable[[DataFrame], DataFrame]], docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """extractors: docs -> (work_id, id, task, statement, confidence). -> problems, votes, disagreements.

    Of problems alike in task and in the first 240 characters of the folded statement the most
    confident stays, the first extractor's among equals.
    """
    every = None
    for i, (name, run) in enumerate(extractors.items()):
        d = run(docs).withColumn("extractor", F.lit(name)).withColumn("_i", F.lit(-i))
        every = d if every is None else every.unionByName(d)
    keyed = every.withColumn("_key", F.substring(collapse(casefold(F.col("statement"))), 1, 240))
    best = keep_best(keyed, ["work_id", "task", "_key"], ["confidence", "_i"]).drop("_key", "_i")
    votes = every.groupBy("work_id", "extractor").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    told = records.disagreement(every.select(F.col("work_id").alias("item"), "extractor", F.col("task").alias("family")))
    return best, votes, told


def embed(c: Column, provider: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors of texts by a provider that takes a batch; null texts are empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider([x or "" for x in s]))

    return run(c)


def propose_and_evaluate(families: DataFrame, propose: Callable[[pd.DataFrame], pd.DataFrame], schema: str, evaluate: Callable[[Column], Column] | None = None) -> DataFrame:
    """families(family, ...): proposals of each family, with what an evaluator says of them; without one they are unresolved."""
    d = families.groupBy("family").applyInPandas(propose, schema)
    return d.withColumn("evaluation", evaluate(F.col("proposal")) if evaluate else F.lit("unresolved"))


def analyse(documents: DataFrame, problems: DataFrame, fields: list[str], covered: DataFrame, scopes: DataFrame, yields: DataFrame, stable: bool, unknown_terms: int = 0) -> dict[str, DataFrame]:
    """The whole analysis as frames: intelligence, quality, pairs, coverage, priorities and what to do next.

    documents(id, sections, references), problems as for score_pairs, covered as for strata,
    scopes(scope, u, n, g, h, d), yields(iteration, retrieved, works, terms, concepts, citations, signatures).
    """
    score, why = coverage.priority(*[F.col(c) for c in "unghd"])
    priorities = scopes.select("scope", score.alias("score"), why.alias("reasons"), "g", "h", "d").orderBy(F.col("score").desc(), "scope")
    novelty = audited_novelty(F.col("retrieved"), **{c: F.col(c) for c in ("works", "terms", "concepts", "citations", "signatures")})
    last = saturation(yields, novelty, 4, 3, 0.04, F.lit(stable)).orderBy(F.col("iteration").desc()).select("saturated").limit(1)
    top = priorities.limit(1)
    state = last.join(top, F.lit(True), "full")  # one row each at most
    action = coverage.feedback(F.coalesce("saturated", F.lit(False)), F.lit(unknown_terms), F.col("h"), F.col("g"), F.col("d"))
    pairs = similarity.score_pairs(problems).withColumn("structure", similarity.structural()).withColumn("aggregate", similarity.aggregate())
    return {
        "intelligence": documents.select("id", records.intelligence(F.col("sections"), F.size("references")).alias("told")).select("id", "told.*"),
        "quality": records.completeness(problems, fields),
        "pairs": pairs,
        "coverage": coverage.strata(covered),
        "priorities": priorities,
        "feedback": state.select(action.alias("action"), "scope"),
    }


def ingest(spark: SparkSession, assets: DataFrame, path: str, store: str, format_: str | None = None) -> tuple[DataFrame, DataFrame]:
    """assets(id, file, availability, tdm, retention, mime, representation): those that may be mined and kept are read from path, stored by content, and parsed -> documents, audit.

    audit has a row for each asset, with why it was refused; documents have id, key and the parsed document.
    """
    from ..sources.files import put_blobs

    may = coverage.decide(F.col("availability"), F.col("tdm"))
    keep = coverage.decide(F.col("availability"), F.col("retention"))
    audit = assets.withColumn("outcome", F.when(may != "allowed", F.concat(F.lit("tdm:"), may)).when(keep != "allowed", F.concat(F.lit("retention:"), keep)).otherwise("fetched"))
    wanted = audit.where("outcome = 'fetched'").withColumn("format", F.lit(format_) if format_ else records.source_format(F.col("mime"), F.col("representation")))
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    read = put_blobs(wanted.join(files, "file"), store)
    source = F.decode("content", "UTF-8")
    parsed = F.lit(None).cast(parsers.PARSED)
    for name in ("text", "latex", "html", "jats", "tei"):
        parsed = F.when(F.col("format") == name, parsers.parser(name)(source)).otherwise(parsed)
    return read.select("id", "key", parsed.alias("document")), audit.select("id", "outcome")


def campaign(steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Steps in order (compile, batch, harvest, enrich, enqueue, say), each given what the ones before made; a summary counts each."""
    made: dict[str, DataFrame] = {}
    for name, run in steps.items():
        made[name] = run(made)
    counts = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return made | {"summary": counts}
