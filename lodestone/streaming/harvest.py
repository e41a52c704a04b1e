"""Resumable ingestion: file streams whose checkpoint is the cursor, and paged sources with a table of checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

STATE = "source string, fingerprint string, page int, cursor string, next_cursor string, status string, retrieved long, new long, error string, seq long"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen_stream(stream: DataFrame, key: str, ts: str, late: str = "10 days") -> DataFrame:
    """The first row of each key, with state dropped once it is late."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    d = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return d.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or an empty one of the schema (None without one) if nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if schema else None


def harvest(stream: DataFrame, sink: str, checkpoint: str, key: list[str], buckets: int = 64) -> None:
    """Runs all that is there into Parquet, page by page; pages that a checkpoint has are not run again, and known keys are not written twice.

    The sink is parted by a hash of the key, and of it only the parts that a page touches are read, keys alone.
    """
    spark = stream.sparkSession

    def page(batch: DataFrame, n: int) -> None:
        batch = cut(batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        old = _table(spark, sink)
        if old is not None:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets`
            batch = batch.join(old.where(F.col("bucket").isin(touched)).select(*key), key, "left_anti")
        batch.write.mode("append").partitionBy("bucket").parquet(sink)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(page).start().awaitTermination()


@dataclass
class Outcome:
    source: str
    pages: int = 0
    hits: int = 0
    exhausted: bool = False
    saturated: bool = False
    next_cursor: str | None = None
    novelty: list[float] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def checkpoints(spark: SparkSession, state: str) -> DataFrame:
    """The last word on each page of each source and request."""
    last = Window.partitionBy("source", "fingerprint", "page").orderBy(F.col("seq").desc())
    return _table(spark, state, STATE).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def harvest_pages(spark: SparkSession, source: str, fingerprint: str, fetch: Callable[[str | None, int], tuple[DataFrame, str | None]], state: str, sink: str, max_pages: int = 100, max_records: int | None = None, saturated: Callable[[list[float]], bool] | None = None, cursor: str | None = None, stop_on_error: bool = False) -> Outcome:
    """Pages of a source, from after the last complete one on, into sink; fetch(cursor, page) gives hits(work_id, ...) and the next cursor.

    An exhausted request is not made again. A page is written under its number, so one that
    failed halfway is written anew. A failure is recorded, ends this run, and is tried again by the next.
    """
    out = Outcome(source)
    own = (F.col("source") == source) & (F.col("fingerprint") == fingerprint)
    done = checkpoints(spark, state).where(own & (F.col("status") == "completed")).orderBy(F.col("page").desc()).select("page", "next_cursor").first()
    seq = (_table(spark, state, STATE).agg(F.max("seq")).first()[0] or 0) + 1
    page, at = (0, cursor) if done is None else (done.page + 1, done.next_cursor)
    if done is not None and not at:
        out.exhausted = True
        return out
    known = f"{sink}/source={source}/fingerprint={fingerprint}"
    while out.pages < max_pages and (max_records is None or out.hits < max_records):
        row = {"page": page, "cursor": at, "next_cursor": None, "status": "completed", "retrieved": 0, "new": 0, "error": None}
        try:
            hits, following = fetch(at, page)
            hits = cut(hits)
            row["retrieved"] = hits.count()
            works = hits.where("work_id IS NOT NULL").select("work_id").distinct()
            old = _table(spark, known)
            row["new"] = (works if old is None else works.join(old.where(F.col("page") < page).select("work_id"), "work_id", "left_anti")).count()
            hits.write.mode("overwrite").parquet(f"{known}/page={page}")
            row["next_cursor"] = following
        except Exception as e:  # what a source raises is its own
            row |= {"status": "failed", "error": f"page:{page}:{type(e).__name__}:{e}"}
        values = (source, fingerprint, row["page"], row["cursor"], row["next_cursor"], row["status"], row["retrieved"], row["new"], row["error"], seq)
        spark.createDataFrame([values], STATE).coalesce(1).write.mode("append").parquet(state)
        seq += 1
        if row["error"]:
            out.errors.append(row["error"])
            if stop_on_error:
                raise RuntimeError(row["error"])
            break
        out.pages, out.hits = out.pages + 1, out.hits + row["retrieved"]
        out.novelty.append(row["new"] / row["retrieved"] if row["retrieved"] else 0.0)
        at = out.next_cursor = row["next_cursor"]
        out.exhausted = not at
        if saturated and saturated(out.novelty):
            out.saturated = True
            break
        if out.exhausted:
            break
        page += 1
    return out


def no_news(least: int = 3, window: int = 3, threshold: float = 0.03) -> Callable[[list[float]], bool]:
    """The stop rule: enough pages, and none of the last ones above the threshold."""
    return lambda novelty: len(novelty) >= max(least, window) and all(x <= threshold for x in novelty[-window:])


def harvest_batch(spark: SparkSession, batch: str, queries: Iterable[str], fetch: Callable[[str], DataFrame], state: str, sink: str, saturated: Callable[[list[float]], bool] | None = None) -> Outcome:
    """One request for each query of a batch; complete ones are recovered, not made again, failed ones are recorded and made anew by the next run."""
    out = Outcome(batch)
    for i, q in enumerate(queries):
        one = harvest_pages(spark, batch, f"q{i}", lambda _, __, q=q: (fetch(q), None), state, sink, max_pages=1)
        told = checkpoints(spark, state).where((F.col("source") == batch) & (F.col("fingerprint") == f"q{i}")).select("retrieved", "new").first()
        out.pages, out.hits, out.errors = out.pages + one.pages, out.hits + one.hits, out.errors + one.errors
        if not one.errors:
            out.novelty.append(told.new / told.retrieved if told.retrieved else 0.0)
        if saturated and saturated(out.novelty):
            out.saturated = True
            break
    out.exhausted = not out.errors and not out.saturated
    return out


def harvest_sources(spark: SparkSession, sources: dict[str, Callable[[str | None, int], tuple[DataFrame, str | None]]], fingerprint: str, state: str, sink: str, **limits) -> tuple[dict[str, Outcome], DataFrame | None]:
    """Each source by itself, so that one that fails leaves the others alone -> outcomes, and the distinct works of all."""
    outcomes = {name: harvest_pages(spark, name, fingerprint, fetch, state, sink, **limits) for name, fetch in sources.items()}
    found = _table(spark, sink)
    return outcomes, None if found is None else found.where("work_id IS NOT NULL").select("work_id").distinct()
