"""Vocabularies: terms of concepts compiled to queries, historical terms, and imports of native records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, quoted, stable_id

# fixed values: weights of the kinds of term, and of the others
WEIGHTS = {"canonical": 1.5, "preferred": 1.5, "synonym": 1.4, "historical": 1.3, "abbreviation": 1.25, "search_phrase": 1.0, "narrower": 0.9, "broader": 0.7, "related": 0.5}
OTHER = 0.8
# fixed values: the kinds that a precise query takes, and those that a balanced one leaves out
PRECISE, UNBALANCED = ("preferred", "synonym", "abbreviation", "canonical"), ("related", "broader")

# fixed values: stages of a search for high recall, and requests that each may make
CASCADE = [(1, "controlled_vocabulary", 20), (2, "lexical", 20), (3, "historical_terms", 10), (4, "citation_expansion", 25), (5, "semantic", 15), (6, "related_works", 10)]


def granted(requests: DataFrame) -> DataFrame:
    """requests(search, stage) -> search, place, stage, requests, granted: how many of a search's requests each stage may make. A stage that the cascade doesn't have grants none (place null)."""
    stages = requests.sparkSession.createDataFrame(CASCADE, "place int, stage string, cap int")  # six rows
    n = requests.groupBy("search", "stage").agg(F.count("*").alias("requests")).join(F.broadcast(stages), "stage", "left")
    return n.select("search", "place", "stage", "requests", F.least("requests", F.coalesce("cap", F.lit(0))).cast("long").alias("granted"))


def allowed(kind: Column, mode: str = "high_recall", historical: bool = True) -> Column:
    """Whether a mode (precision, balanced, high_recall) takes a kind of term."""
    taken = {"precision": kind.isin(*PRECISE), "balanced": ~kind.isin(*UNBALANCED), "high_recall": F.lit(True)}[mode]
    return taken if historical else taken & (kind != "historical")


def weight(kind: Column) -> Column:
    out = F.lit(OTHER)
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def folded(c: Column) -> Column:
    return F.trim(casefold(c))


def related(asked: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = ("broader", "narrower", "related"), most: int = 8) -> DataFrame:
    """asked(id), relations(ord, source, relationship, target) -> id: targets of the first `most` relations, by ord, that start at one asked for."""
    met = relations.where(F.col("relationship").isin(*kinds)).join(asked.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return met.orderBy("ord").limit(most).select(F.col("target").alias("id"))


def first_concepts(concepts: DataFrame, disciplines: DataFrame, most: int = 100) -> DataFrame:
    """concepts(id, discipline_id) of the disciplines(id), the first by id."""
    return concepts.join(disciplines.select(F.col("id").alias("discipline_id")).distinct(), "discipline_id", "left_semi").orderBy("id").limit(most)


def clauses(concepts: DataFrame, terms: DataFrame, mode: str = "high_recall", historical: bool = True, most: int = 24) -> DataFrame:
    """concepts(id, name), terms(ord, concept_id, term, kind) -> concept_id, text, kind, weight: the best `most` of each concept.

    The canonical name comes first; of terms that fold alike the first by ord counts; then by weight and folded text.
    """
    own = concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("text"), F.lit("canonical").alias("kind"), F.lit(-1).cast("long").alias("ord"))
    more = terms.where(allowed(F.col("kind"), mode, historical)).join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").select("concept_id", F.col("term").alias("text"), "kind", F.col("ord").cast("long").alias("ord"))
    every = own.unionByName(more).withColumn("f", folded(F.col("text"))).where("f <> '' OR ord = -1")
    one = every.groupBy("concept_id", "f").agg(F.min_by(F.struct("text", "kind"), "ord").alias("x")).select("concept_id", "f", "x.*").withColumn("weight", weight(F.col("kind")))
    best = Window.partitionBy("concept_id").orderBy(F.col("weight").desc(), casefold(F.col("text")))
    return one.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).select("concept_id", "text", "kind", "weight")


def plan(found: DataFrame, order: DataFrame) -> DataFrame:
    """clauses, order(concept_id, ord) -> one row: n, concepts and the OR query of all; of clauses that fold alike the heaviest counts, the first concept's among equals."""
    best = found.join(order, "concept_id").withColumn("f", folded(F.col("text"))).groupBy("f").agg(F.max_by(F.struct("text", "weight", "concept_id"), F.struct("weight", -F.col("ord"))).alias("x")).select("x.*")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), casefold(F.col("text")).alias("f"), quoted(F.col("text")).alias("q"))))
    return best.agg(F.count("*").alias("n"), F.count_distinct("concept_id").alias("concepts"), F.array_join(F.transform(listed, lambda x: x["q"]), " OR ").alias("rendered"))


def search_history(terms: DataFrame, query: str, vocabulary: str | None = None) -> DataFrame:
    """terms(vocabulary, release, term, aliases): those of which a form holds the query, case folded, in order of vocabulary, release and term."""
    needle = F.lit(query.casefold())
    forms = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    met = terms.where(F.exists(forms, lambda x: F.contains(casefold(x), needle)))
    return (met if vocabulary is None else met.where(F.col("vocabulary") == vocabulary)).orderBy("vocabulary", "release", "term")


def import_native(records: DataFrame, source: str, release: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records(native_id, label, alternate, historical, broader, narrower, related, replaced_by, definition, deprecated) -> concepts, terms and relations, each once. Targets may be unknown."""
    concept = lambda c: stable_id("native-concept", F.concat(F.lit(f"{source}:{release}:"), c))
    r = records.withColumn("id", concept(F.col("native_id")))
    concepts = r.select("id", F.col("label").alias("name"), "definition", F.when(F.col("deprecated"), "deprecated").otherwise("native").alias("status")).dropDuplicates(["id"])
    told = f"release={release}"
    one = lambda kind, c, note: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind"), note.alias("context")))
    every = F.concat(one("preferred", F.array("label"), F.concat(F.lit("native_id="), F.col("native_id"), F.lit(f";{told}"))), one("synonym", F.col("alternate"), F.lit(told)), one("historical", F.col("historical"), F.lit(told)))
    terms = r.select(F.col("id").alias("concept_id"), F.explode(every).alias("t")).select("concept_id", "t.*").distinct()
    edge = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("relationship"), concept(t).alias("target")))
    edges = F.concat(*[edge(k, F.col(c)) for k, c in (("broader", "broader"), ("narrower", "narrower"), ("related", "related"), ("superseded_by", "replaced_by"))])
    relations = r.select(F.col("id").alias("source"), F.explode(edges).alias("e")).select("source", "e.*").distinct()
    return concepts, terms, relations


def feedback(candidates: DataFrame) -> DataFrame:
    """candidates(id, term) as records for review."""
    return candidates.select(F.col("id").alias("candidate_id"), "term", F.lit("candidate").alias("status"), F.lit(True).alias("retrieval_only"))
