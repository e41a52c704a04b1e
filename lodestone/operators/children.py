"""Records with children in tables of their own: parents are replaced, children made anew or joined by what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as j
from ..functions.text import stable_id
from ..sources.tableset import Changes
from .envelopes import citations
from .state import find_work, owned, store, upsert_works

EVIDENCE = "problem_id string, place int, quote string"
MATH = "problem_id string, object_id string, role string"
OBJECTS = "id string, name string, object_type string, canonical_form string"
METHOD = "problem_id string, method_id string, role string"
METHODS = "id string, name string, method_type string"
PROBLEMS = "id string, work_id string, task_family string, statement string, confidence double"
FAMILIES = "id string, name string"
MEMBERS = "family_id string, member_id string, place int"
WORKS = "id string, title string, abstract string, year int"
IDENTIFIERS = "work_id string, scheme string, value string"
VERSIONS = "id string, work_id string, label string, provider string"
AUTHORS = "id string, name string"
WORK_AUTHORS = "work_id string, author_id string, position int"
ASSETS = "id string, work_id string, representation string, url string"
PROVENANCE = "work_id string, provider string, record string"
INTEGRITY = "id string, work_id string, subject string, relation string, object string, provider string, status string"
REVIEWS = "id string, object_type string, object_id string, reviewer string, decision string, notes string, payload string"
EXPERIMENTS = "id string, name string, parameters string, status string, metrics string"
ENVELOPES = "id string, run_id string, spec string, request_id string, query_fingerprint string, response_sha256 string, citations long, lineage long"
RETRIEVALS = "id string, provider string, query string, status string, hits long, error string"
HITS = "run_id string, place int, work_id string, rank long"
RUNS = "id string, work_id string, extractor string, status string, problem_count long, error string"


def _anew(old: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """Children after those of the parents(problem_id) were made anew."""
    return old.join(parents, "problem_id", "left_anti").unionByName(new)


def put_problems(c: Changes, new: DataFrame) -> None:
    """new(id, work_id, task_family, statement, confidence, evidence: array<string>, objects: array<struct<name, object_type, representation, role>>, known_methods and classical_baselines: array<struct<name, method_type, role>>): the row is replaced, with it all its children.

    Objects and methods are rows of their own, known by what they are; the last writer's words stay. Of rows with one id, which should be equal, one counts.
    """
    one = new.dropDuplicates(["id"])
    ids = one.select(F.col("id").alias("problem_id"))
    rows = one.select("id", "work_id", "task_family", "statement", "confidence")
    c["problems"] = store("problem", c.get("problems", PROBLEMS), rows)
    c["problem_evidence"] = _anew(c.get("problem_evidence", EVIDENCE), one.select(F.col("id").alias("problem_id"), F.posexplode("evidence").alias("place", "quote")), ids)
    o = one.select(F.col("id").alias("problem_id"), F.explode("objects").alias("o")).select("problem_id", "o.*")
    o = o.withColumn("object_id", stable_id("mathematical-object", F.concat_ws(":", "object_type", "name", F.coalesce("representation", F.lit("")))))
    c["objects"] = store("problem", c.get("objects", OBJECTS), o.select(F.col("object_id").alias("id"), "name", "object_type", F.col("representation").alias("canonical_form")))
    c["problem_objects"] = _anew(c.get("problem_objects", MATH), o.select("problem_id", "object_id", F.coalesce("role", F.lit("unspecified")).alias("role")), ids)
    kinds = [one.select(F.col("id").alias("problem_id"), F.explode(k).alias("m"), F.lit(role).alias("_role")).select("problem_id", "m.*", "_role") for k, role in (("known_methods", "known_method"), ("classical_baselines", "classical_baseline"))]
    m = kinds[0].unionByName(kinds[1]).withColumn("method_id", stable_id("scientific-method", F.concat_ws(":", F.coalesce("method_type", F.lit("unknown")), "name")))
    c["methods"] = store("problem", c.get("methods", METHODS), m.select(F.col("method_id").alias("id"), "name", "method_type"))
    c["problem_methods"] = _anew(c.get("problem_methods", METHOD), m.select("problem_id", "method_id", F.coalesce("role", "_role").alias("role")), ids)


def put_families(c: Changes, new: DataFrame) -> None:
    """new(id, name, members: array<string>): the row is replaced; members join those that are there, once each, in order, behind the ones before."""
    one = new.dropDuplicates(["id"])
    c["families"] = store("problem", c.get("families", FAMILIES), one.select("id", "name"))
    old = c.get("family_members", MEMBERS)
    listed = one.select(F.col("id").alias("family_id"), F.posexplode(F.array_distinct("members")).alias("p", "member_id"))
    fresh = listed.join(old, ["family_id", "member_id"], "left_anti")
    last = old.groupBy("family_id").agg(F.max("place").alias("last"))
    placed = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("family_id").orderBy("p"))
    c["family_members"] = old.unionByName(fresh.join(last, "family_id", "left").select("family_id", "member_id", placed.cast("int").alias("place")))


def extract_and_store(spark: SparkSession, folder: str, docs: DataFrame, extractor: str, run: Callable[[DataFrame], DataFrame]) -> str:
    """Runs an extractor over docs(work_id, ...) into the stores -> status. A run a work is `running` at first; then its problems and `completed` are one commit, or it is `failed` with the error and no problem is there."""
    runs = docs.select(F.col("work_id").cast("string").alias("work_id")).distinct().select(stable_id("extraction-run", F.concat_ws(":", F.lit(extractor), "work_id")).alias("id"), "work_id", F.lit(extractor).alias("extractor"))
    say = lambda d, status, n, error: d.select("id", "work_id", "extractor", F.lit(status).alias("status"), n.cast("long").alias("problem_count"), F.lit(error).cast("string").alias("error"))
    with Changes(spark, folder) as c:
        c["runs"] = store("extraction_run", c.get("runs", RUNS), say(runs, "running", F.lit(0), None))
    try:
        with Changes(spark, folder) as c:
            found = run(docs)
            put_problems(c, found)
            n = found.groupBy("work_id").agg(F.count_distinct("id").alias("n"))
            c["runs"] = store("extraction_run", c.get("runs", RUNS), say(runs.join(n, "work_id", "left"), "completed", F.coalesce("n", F.lit(0)), None))
    except Exception as e:  # what an extractor raises is its own
        with Changes(spark, folder) as c:
            c["runs"] = store("extraction_run", c.get("runs", RUNS), say(runs, "failed", F.lit(0), f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"))
        return "failed"
    return "completed"


def put_works(c: Changes, new: DataFrame) -> None:
    """new(id, title, abstract, year, identifiers, version: struct<label, provider>, authors: array<struct<id, name>>, assets: array<struct<id, representation, url>>, provenance: array<struct<provider, record>>).

    A work that is known by id or identifier is overwritten, by nulls too. Identifiers and provenance
    are added, versions and authors replaced, an asset stays with the work that had it first.
    """
    works, ids = c.get("works", WORKS), c.get("identifiers", IDENTIFIERS)
    told = owned(works, ids, new)
    c["works"], c["identifiers"] = upsert_works(works, ids, new)
    version = told.where("version IS NOT NULL").select(stable_id("work-version", F.concat_ws(":", "_id", "version.label")).alias("id"), F.col("_id").alias("work_id"), "version.label", "version.provider")
    c["versions"] = store("document", c.get("versions", VERSIONS), version)
    a = told.select("_id", F.posexplode("authors").alias("p", "a"))
    c["authors"] = store("document", c.get("authors", AUTHORS), a.select("a.id", "a.name"))
    c["work_authors"] = store("work_author", c.get("work_authors", WORK_AUTHORS), a.select(F.col("_id").alias("work_id"), F.col("a.id").alias("author_id"), (F.col("p") + 1).alias("position")))
    assets = told.select("_id", F.explode("assets").alias("a")).select("a.id", F.col("_id").alias("work_id"), "a.representation", "a.url")
    c["assets"] = store("asset", c.get("assets", ASSETS), assets)
    c["provenance"] = store("provenance", c.get("provenance", PROVENANCE), told.select(F.col("_id").alias("work_id"), F.explode("provenance").alias("p")).select("work_id", "p.provider", "p.record"))


def put_integrity(c: Changes, told: DataFrame) -> None:
    """told(asked, subject, relation, object, provider, status): what was asked is resolved to a work by its identifier in any spelling; an assertion that is there is overwritten, but for a work that is not found now."""
    new = find_work(told, c.get("identifiers", IDENTIFIERS), "asked").withColumnRenamed("work", "work_id")
    key = stable_id("integrity-assertion", F.concat_ws(":", "subject", "relation", F.coalesce("object", F.lit("")), "provider"))
    new = new.withColumn("id", key).select("id", "work_id", "subject", "relation", "object", "provider", "status").dropDuplicates(["id"])
    old = c.get("integrity", INTEGRITY)
    kept = old.select("id", F.col("work_id").alias("_had"))
    new = new.join(kept, "id", "left").withColumn("work_id", F.coalesce("work_id", "_had")).drop("_had")
    c["integrity"] = store("document", old, new)


def put_reviews(c: Changes, new: DataFrame) -> None:
    """new(object_type, object_id, reviewer, decision, notes, payload): one review for each of these but the payload, which the last replaces."""
    key = stable_id("review-event", F.concat_ws(":", "object_type", "object_id", "reviewer", "decision", F.coalesce("notes", F.lit(""))))
    c["reviews"] = store("review", c.get("reviews", REVIEWS), new.withColumn("id", key).select(*[f.split()[0] for f in REVIEWS.split(", ")]))


def start_experiments(c: Changes, new: DataFrame) -> None:
    """new(id, name, parameters): runs that begin; one that is there begins anew."""
    c["experiments"] = store("experiment", c.get("experiments", EXPERIMENTS), new.select("id", "name", "parameters", F.lit("running").alias("status"), F.lit(None).cast("string").alias("metrics")))


def finish_experiments(c: Changes, done: DataFrame) -> None:
    """done(id, metrics): runs that end, with their metrics, or those they had if none are given. One that never began is an error when the change is kept."""
    old = c.get("experiments", EXPERIMENTS)
    d = done.dropDuplicates(["id"]).withColumnRenamed("metrics", "_new")
    unknown = d.join(old, "id", "left_anti").select(F.raise_error(F.concat(F.lit("unknown experiment: "), "id")).cast("string").alias("id"))
    ended = old.join(d.withColumn("_done", F.lit(True)), "id", "left").select("id", "name", "parameters", F.when(F.col("_done"), "completed").otherwise(F.col("status")).alias("status"), F.coalesce("_new", "metrics").alias("metrics"))
    none = F.lit(None).cast("string")
    c["experiments"] = ended.unionByName(unknown.select("id", none.alias("name"), none.alias("parameters"), none.alias("status"), none.alias("metrics")))


def put_envelopes(c: Changes, new: DataFrame) -> None:
    """new(id, run_id, json): appended, with request, query and response of the first citation that tells its execution, and counts of citations and lineage."""
    v = new.select("id", "run_id", j.parsed(F.col("json")).alias("v"))
    runs = F.filter(F.transform(citations(F.col("v")), lambda x: j.field(x, "execution")), j.is_object)
    d = v.select("id", "run_id", j.text(F.col("v"), "spec").alias("spec"), F.get(runs, 0).alias("x"), F.size(citations(F.col("v"))).cast("long").alias("citations"), F.size(j.items(F.col("v"), "lineage")).cast("long").alias("lineage"))
    c["envelopes"] = store("envelope", c.get("envelopes", ENVELOPES), d.select("id", "run_id", "spec", *[j.text(F.col("x"), n).alias(n) for n in ("request_id", "query_fingerprint", "response_sha256")], "citations", "lineage"))


def put_retrieval(c: Changes, run: DataFrame, hits: DataFrame) -> None:
    """run(id, provider, query, error), hits(run_id, place, work_id, rank): runs with how many hits they had and whether they failed, their hits, and who told of each work."""
    n = hits.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("hits"))
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("completed")
    c["retrievals"] = store("retrieval_run", c.get("retrievals", RETRIEVALS), run.join(n, "id", "left").select("id", "provider", "query", status.alias("status"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "error"))
    c["hits"] = store("retrieval_hit", c.get("hits", HITS), hits.select("run_id", "place", "work_id", "rank"))
    told = hits.where("work_id IS NOT NULL").join(run.select(F.col("id").alias("run_id"), "provider"), "run_id").select("work_id", "provider", F.col("run_id").alias("record"))
    c["provenance"] = store("provenance", c.get("provenance", PROVENANCE), told)
