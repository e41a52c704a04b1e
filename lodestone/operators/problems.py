"""Problems by rule: four lexicons searched in one pass, rows of documents to rows of problems with evidence.

A document is a row with sections. A task of Python runs a multi-pattern automaton over
each section and sentence and gives back the first place of each pattern; families,
operations, structures, objects, spans and confidence are column expressions on those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, stable_id

# fixed values: names and the folded substrings that tell them, in order
FAMILIES = {
    "optimization": ("optimiz", "minimiz", "maximiz", "objective function"),
    "search": ("search problem", "find a", "locate a"),
    "sampling": ("sampling", "draw samples", "sample from"),
    "estimation": ("estimate", "estimation", "estimator"),
    "inference": ("inference", "posterior", "infer"),
    "simulation": ("simulate", "simulation", "numerical model"),
    "prediction": ("predict", "forecast"),
    "classification": ("classif", "label prediction"),
    "control": ("optimal control", "control policy", "controller"),
    "inverse_problem": ("inverse problem", "reconstruct", "tomograph"),
    "linear_system": ("linear system", "solve ax", "linear solve"),
    "eigenproblem": ("eigenvalue", "eigenvector", "eigensystem"),
    "spectral_problem": ("spectrum", "spectral decomposition", "spectral problem"),
    "differential_equation": ("differential equation", "pde", "ode"),
    "stochastic_process": ("stochastic process", "markov process", "markov chain"),
    "graph_problem": ("graph problem", "network flow", "shortest path"),
    "constraint_satisfaction": ("constraint satisfaction", "satisfiability", "feasible assignment"),
    "planning": ("planning problem", "trajectory planning", "schedule"),
    "dynamical_system": ("dynamical system", "phase space", "trajectory"),
    "rare_event": ("rare event", "rare-event"),
    "integration": ("numerical integration", "integral estimation", "quadrature"),
    "counting": ("counting problem", "count the number", "partition function"),
}
OPERATIONS = {
    "matrix-vector multiplication": ("matrix-vector", "matrix vector"),
    "linear solve": ("linear system", "linear solve"),
    "eigenvalue computation": ("eigenvalue", "eigensolver"),
    "sampling": ("sampling", "monte carlo"),
    "numerical integration": ("quadrature", "numerical integration"),
    "gradient evaluation": ("gradient", "backpropagation"),
    "graph traversal": ("graph traversal", "breadth-first", "depth-first"),
    "optimization update": ("gradient descent", "newton method", "optimization iteration"),
    "time stepping": ("time step", "time-stepping", "integrator"),
}
STRUCTURES = {
    "sparse": ("sparse", "sparsity"),
    "low-rank": ("low-rank", "low rank"),
    "symmetric": ("symmetric matrix", "symmetry"),
    "local": ("local interaction", "locality"),
    "convex": ("convex",),
    "non-convex": ("nonconvex", "non-convex"),
    "graph-structured": ("graph", "network"),
    "high-dimensional": ("high-dimensional", "high dimensional"),
    "ill-conditioned": ("ill-conditioned", "ill conditioned"),
    "periodic": ("periodic", "periodicity"),
}
OBJECTS = {
    "matrix": ("matrix", "matrices"),
    "graph": ("graph", "network"),
    "tensor": ("tensor",),
    "probability_distribution": ("probability distribution", "density", "posterior"),
    "differential_equation": ("differential equation", "pde", "ode"),
    "operator": ("operator",),
    "hamiltonian": ("hamiltonian",),
    "markov_chain": ("markov chain",),
    "optimization_landscape": ("loss landscape", "energy landscape", "objective landscape"),
}
HIGH_VALUE = ("inputs", "outputs", "objective", "constraints", "access_model", "mathematical_objects", "algorithmic_operations", "reported_bottlenecks")
EXPECTED = ("inputs", "outputs", "objective", "constraints", "state_space", "access_model", "data_model", "mathematical_objects", "operators", "algorithmic_operations", "known_methods", "classical_baselines", "scale_parameters", "reported_bottlenecks", "assumptions", "evidence")
BEFORE, AFTER, QUOTE, FAMILIES_KEPT = 180, 360, 700, 3

HIT = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("sentence", T.IntegerType()), T.StructField("quote", T.StringType())]))


@lru_cache(maxsize=4)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def _first(automaton, text: str) -> Iterator[tuple[str, int]]:
    seen = set()
    for end, p in automaton.iter(text.casefold()):
        if p not in seen:
            seen.add(p)
            yield p, end - len(p) + 1


def _search(automaton, sections: list[str]) -> list[dict]:
    """The first place of each pattern, by section, and the first sentence of the whole text that holds it."""
    found: dict[str, dict] = {}
    for i, text in enumerate(sections):
        if text.strip():
            for p, at in _first(automaton, text):
                found.setdefault(p, {"pattern": p, "section": i, "at": at, "sentence": None, "quote": None})
    left = set(found)
    if left:
        whole = re.sub(r"\s+", " ", "\n\n".join(s for s in sections if s.strip()))
        for k, sentence in enumerate(re.split(r"(?<=[.!?])\s+", whole)):
            for p, _ in _first(automaton, sentence):
                if p in left:
                    found[p] |= {"sentence": k, "quote": sentence[:QUOTE]}
                    left.discard(p)
            if not left:
                break
    return [found[p] for p in sorted(found)]


def pattern_hits(docs: DataFrame, patterns: tuple[str, ...], sections: str = "sections") -> DataFrame:
    """docs with `hits`: for each (folded) pattern that occurs, its first section, the place there, the first sentence and that sentence."""

    def run(batches):
        automaton = _automaton(patterns)
        for batch in batches:
            texts = [[s["text"] or "" for s in row or []] for row in batch.column(sections).to_pylist()]
            hits = pa.array([_search(automaton, t) for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, "hits"])

    kind = pa.list_(pa.struct([("pattern", pa.string()), ("section", pa.int32()), ("at", pa.int32()), ("sentence", pa.int32()), ("quote", pa.string())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("hits", HIT)]))


def _listed(items: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, items))


def named(found: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Names, in the lexicon's order, of which a pattern was found."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(found, _listed(p)), F.lit(n)) for n, p in lexicon.items()]))


def extract(docs: DataFrame) -> DataFrame:
    """docs(work_id, asset_id, sections: array<struct<id, text>>) -> up to three problems a document, in the order of families, with what tells them.

    A document without a family, without sections or with null texts alone has none. Other columns of docs are dropped.
    """
    patterns = tuple(sorted({p for lexicon in (FAMILIES, OPERATIONS, STRUCTURES, OBJECTS) for x in lexicon.values() for p in x}))
    d = pattern_hits(docs.select("work_id", "asset_id", "sections"), patterns)
    d = d.withColumn("found", F.col("hits.pattern"))
    d = d.select("*", named(F.col("found"), OPERATIONS).alias("algorithmic_operations"), named(F.col("found"), STRUCTURES).alias("structural_properties"), named(F.col("found"), OBJECTS).alias("mathematical_objects"))
    d = d.select("*", F.posexplode(F.slice(named(F.col("found"), FAMILIES), 1, FAMILIES_KEPT)).alias("place", "task_family"))
    of_family = F.create_map(*[x for n, p in FAMILIES.items() for x in (F.lit(n), _listed(p))])[F.col("task_family")]
    own = F.filter("hits", lambda h: F.array_contains(of_family, h["pattern"]))
    where = let(own, lambda hs: let(F.array_min(F.transform(hs, lambda h: h["section"])), lambda s: F.filter(hs, lambda h: h["section"] == s)))
    first = let(where, lambda hs: F.get(F.filter(F.flatten(F.transform(of_family, lambda p: F.filter(hs, lambda h: h["pattern"] == p))), lambda h: h.isNotNull()), F.lit(0)))
    quote = F.array_min(F.transform(own, lambda h: F.struct(h["sentence"], h["quote"].alias("quote"))))["quote"]
    d = d.select("*", quote.alias("quote"), first.alias("hit")).withColumn("section", F.get("sections", F.col("hit.section")))
    start, end = F.greatest(F.lit(0), F.col("hit.at") - BEFORE), F.least(F.length("section.text"), F.col("hit.at") + F.length("hit.pattern") + AFTER)
    confidence = F.least(F.lit(0.55), F.lit(0.20) + 0.05 * F.size("algorithmic_operations") + 0.04 * F.size("structural_properties"))
    key = F.concat_ws(":", F.col("work_id").cast("string"), F.col("asset_id").cast("string"), "task_family", F.col("place").cast("string"))
    return d.select(
        stable_id("problem", key).alias("problem_id"), "work_id", "asset_id", F.col("place").alias("place"), "task_family",
        F.coalesce("quote", F.concat(F.lit("Candidate "), "task_family", F.lit(" problem."))).alias("statement"), "mathematical_objects", "structural_properties", "algorithmic_operations",
        F.struct(F.lit("task_family").alias("field"), F.col("section.id").alias("section_id"), start.alias("start_char"), end.alias("end_char"), F.substring(F.col("section.text"), start + 1, end - start).alias("text"), F.concat(F.lit("keyword:"), "hit.pattern").alias("rule")).alias("span"),
        confidence.alias("confidence"),
    )


def _filled(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(False)
    c, kind = F.col(field), df.schema[field].dataType
    held = F.size(c) > 0 if isinstance(kind, T.ArrayType | T.MapType) else F.length(c) > 0 if isinstance(kind, T.StringType) else c.isNotNull()
    return F.coalesce(held, F.lit(False))


def completeness(problems: DataFrame, fields: tuple[str, ...] = EXPECTED) -> DataFrame:
    """Adds filled_fields, expected_fields, score (a fraction, not rounded) and missing (in the fields' order); a field that is no column is missing."""
    has = {f: _filled(problems, f) for f in fields}
    filled = sum((h.cast("int") for h in has.values()), F.lit(0))
    return problems.select("*", filled.alias("filled_fields"), F.lit(len(fields)).alias("expected_fields"), (filled / len(fields)).alias("score"), F.array_compact(F.array(*[F.when(~h, F.lit(f)) for f, h in has.items()])).alias("missing"))


def quality(problems: DataFrame) -> DataFrame:
    """problems with evidence_fields (names of fields that have a span), source_version_id, task_family and confidence; adds completeness and evidence_coverage over the eight fields of high value (rounded to 6 places), ambiguity_flags and missing."""
    told = completeness(problems, HIGH_VALUE)
    covered = F.size(F.array_intersect(F.coalesce("evidence_fields", F.array().cast("array<string>")), _listed(HIGH_VALUE)))
    flags = [
        (F.coalesce("task_family", F.lit("unknown")) == "unknown", "unknown task family"),
        (F.coalesce("source_version_id", F.lit("")) == "", "source version not pinned"),
        (F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.5, "low overall extraction confidence"),
    ]
    return told.drop("filled_fields", "expected_fields").withColumnRenamed("score", "completeness").withColumn("completeness", F.round("completeness", 6)).withColumns({"evidence_coverage": F.round(covered / len(HIGH_VALUE), 6), "ambiguity_flags": F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))})


def admitted(assets: DataFrame, works: DataFrame, stored: DataFrame) -> DataFrame:
    """assets(work_id, asset_id, ...) with `error`: null where the work is known and the asset is new or the work's own; else what is wrong.

    works(work_id), stored(asset_id, work_id). An asset that comes twice for two works is refused for all but the smallest.
    """
    known = works.select("work_id").distinct().withColumn("_known", F.lit(True))
    owners = stored.select("asset_id", F.col("work_id").alias("_owner")).unionByName(assets.join(known, "work_id", "left_semi").groupBy("asset_id").agg(F.min("work_id").alias("_owner")).join(stored, "asset_id", "left_anti").select("asset_id", "_owner"))
    d = assets.join(known, "work_id", "left").join(owners, "asset_id", "left")
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown work: "), F.col("work_id").cast("string"))).when(F.col("_owner") != F.col("work_id"), F.concat(F.lit("asset belongs to "), F.col("_owner").cast("string")))
    return d.withColumn("error", error).drop("_known", "_owner")


def process(docs: DataFrame, equations: str = "equations") -> DataFrame:
    """Parsed docs(work_id, asset_id, sections, equations) -> work_id, asset_id, equation_count, problem_ids (in order of family)."""
    found = extract(docs).groupBy("work_id", "asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "problem_id"))), lambda x: x["problem_id"]).alias("problem_ids"))
    return docs.select("work_id", "asset_id", F.size(equations).alias("equation_count")).join(found, ["work_id", "asset_id"], "left").withColumn("problem_ids", F.coalesce("problem_ids", F.array().cast("array<string>")))
