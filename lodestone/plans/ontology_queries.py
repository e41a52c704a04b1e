"""Vocabularies: customers as concepts, orders as their terms, nations as disciplines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ontology
from .registry import query

_KINDS = ("preferred", "synonym", "historical", "abbreviation", "search_phrase", "narrower", "broader", "related", "odd")
_TERMS = "SELECT o_custkey AS concept_id, o_orderpriority || ' ' || o_orderkey % 50 AS term, (['" + "','".join(_KINDS) + "'])[o_orderkey % 9 + 1] AS kind, o_orderkey AS ord FROM orders"
_WEIGHT = "CASE kind WHEN 'canonical' THEN 1.5::DOUBLE WHEN 'preferred' THEN 1.5 WHEN 'synonym' THEN 1.4 WHEN 'historical' THEN 1.3 WHEN 'abbreviation' THEN 1.25 WHEN 'search_phrase' THEN 1.0 WHEN 'narrower' THEN 0.9 WHEN 'broader' THEN 0.7 WHEN 'related' THEN 0.5 ELSE 0.8 END"


def _clauses(concepts: str, most: int, keep: str) -> str:
    return f"""k AS ({concepts}), e AS (SELECT id AS concept_id, name AS text, 'canonical' AS kind, -1 AS ord FROM k UNION ALL SELECT concept_id, term, kind, ord FROM ({_TERMS}) WHERE concept_id IN (SELECT id FROM k) AND {keep}),
f AS (SELECT *, trim(lower(text)) AS f, row_number() OVER (PARTITION BY concept_id, trim(lower(text)) ORDER BY ord) AS r FROM e), w AS (SELECT concept_id, text, kind, f, {_WEIGHT} AS weight FROM f WHERE r = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY weight DESC, lower(text)) AS r FROM w) WHERE r <= {most})"""


def _tables(t):
    concepts = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("discipline_id"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    terms = t("orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("concept_id"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey") % 50).alias("term"), kind.alias("kind"))
    return concepts, terms


@query("WITH " + _clauses("SELECT c_custkey AS id, c_name AS name FROM customer", 3, "kind NOT IN ('related', 'broader') AND kind <> 'historical'") + " SELECT concept_id, text, kind, weight FROM c")
def concept_clauses(t):
    """The best three terms of each concept, in the balanced mode without historical ones."""
    return ontology.clauses(*_tables(t), mode="balanced", historical=False, most=3)


@query("WITH " + _clauses("SELECT c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 ORDER BY c_custkey LIMIT 100", 8, "true") + """, b AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY weight DESC, concept_id) AS q FROM c)
SELECT count(*) AS n, count(DISTINCT concept_id) AS concepts, md5(string_agg('"' || text || '"', ' OR ' ORDER BY weight DESC, lower(text))) AS rendered FROM (SELECT concept_id, weight, text FROM b WHERE q = 1 AND text LIKE '% %' UNION ALL SELECT concept_id, weight, text FROM b WHERE q = 1 AND text NOT LIKE '% %') z""".replace("""'"' || text || '"'""", """CASE WHEN text LIKE '% %' THEN '"' || text || '"' ELSE text END"""))
def discipline_plan(t):
    """The query of a region's first hundred concepts, over the closure of its nations."""
    concepts, terms = _tables(t)
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    nodes = nodes.unionByName(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    first = ontology.first_concepts(concepts, graph.descendants(nodes, "r1"))
    found = ontology.clauses(first, terms, most=8)
    return ontology.plan(found, first.select(F.col("id").alias("concept_id"), F.col("id").alias("ord"))).withColumn("rendered", F.md5("rendered"))


@query("SELECT l_partkey AS id FROM lineitem l JOIN nation ON l_suppkey = n_nationkey WHERE l_linenumber IN (1, 2) ORDER BY l_orderkey, l_linenumber LIMIT 8")
def related_concepts(t):
    """C14: targets of the first eight relations, of some kinds, of the concepts asked for."""
    kind = F.element_at(F.array(*map(F.lit, ("broader", "narrower", "other", "x", "y", "z", "u"))), F.least(F.col("l_linenumber"), F.lit(7)).cast("int"))
    rel = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_suppkey").alias("source"), kind.alias("relationship"), F.col("l_partkey").alias("target"))
    return ontology.related(t("nation").select(F.col("n_nationkey").cast("long").alias("id")), rel)


@query("SELECT p_partkey, p_brand AS vocabulary, p_type AS release FROM part WHERE p_brand = 'Brand#13' AND (contains(lower(p_name), 'ring') OR contains('old ' || p_size, 'old 1'))")
def history_search(t):
    """Historical terms of a vocabulary of which a form holds the query."""
    terms = t("part").select("p_partkey", F.col("p_brand").alias("vocabulary"), F.col("p_type").alias("release"), F.col("p_name").alias("term"), F.array(F.concat(F.lit("OLD "), F.col("p_size"))).alias("aliases"))
    a = ontology.search_history(terms, "Ring", "Brand#13").unionByName(ontology.search_history(terms, "old 1", "Brand#13")).select("p_partkey", "vocabulary", "release")
    return a.distinct()


@query("""SELECT 'term' AS what, kind, count(*) AS n FROM (SELECT n_name AS t, 'preferred' AS kind FROM nation UNION ALL SELECT 'alt ' || n_nationkey, 'synonym' FROM nation UNION ALL SELECT 'was ' || n_nationkey, 'historical' FROM nation WHERE n_nationkey % 2 = 0) GROUP BY kind
UNION ALL SELECT 'relation', 'broader', count(*) FROM nation UNION ALL SELECT 'relation', 'superseded_by', count(*) FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'concept', CASE WHEN n_nationkey % 3 = 0 THEN 'deprecated' ELSE 'native' END, count(*) FROM nation GROUP BY 2""")
def native_import(t):
    """Concepts, terms and relations of native records, each once though records repeat; targets may be unknown."""
    k = F.col("n_nationkey")
    one = lambda c, on=None: F.array(c) if on is None else F.when(on, F.array(c)).otherwise(F.array().cast("array<string>"))
    alt = F.concat(F.lit("alt "), k)
    r = t("nation").select(k.cast("string").alias("native_id"), F.col("n_name").alias("label"), F.array(alt, alt).alias("alternate"), one(F.concat(F.lit("was "), k), k % 2 == 0).alias("historical"), one(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("broader"), one(F.lit("x"), F.lit(False)).alias("narrower"), F.lit(None).cast("array<string>").alias("related"), one(F.lit("gone"), k % 3 == 0).alias("replaced_by"), F.lit(None).cast("string").alias("definition"), (k % 3 == 0).alias("deprecated"))
    concepts, terms, relations = ontology.import_native(r.unionByName(r), "nations", "2024")
    count = lambda what, d, c: d.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count("term", terms, "kind").unionByName(count("relation", relations, "relationship")).unionByName(count("concept", concepts, "status"))


@query("SELECT DISTINCT p_name AS candidate_id, p_name AS term, 'candidate' AS status, true AS retrieval_only FROM part")
def vocabulary_feedback(t):
    """Candidate terms as records for review."""
    return ontology.feedback(t("part").select(F.col("p_name").alias("id"), F.col("p_name").alias("term")).distinct())


_STAGES = ["controlled_vocabulary", "lexical", "historical_terms", "citation_expansion", "semantic", "related_works", "guesses"]


@query("WITH r AS (SELECT l_quantity::BIGINT AS search, (['controlled_vocabulary', 'lexical', 'historical_terms', 'citation_expansion', 'semantic', 'related_works', 'guesses'])[l_partkey % 7 + 1] AS stage FROM lineitem) SELECT search, stage, CASE stage WHEN 'controlled_vocabulary' THEN 1 WHEN 'lexical' THEN 2 WHEN 'historical_terms' THEN 3 WHEN 'citation_expansion' THEN 4 WHEN 'semantic' THEN 5 WHEN 'related_works' THEN 6 END AS place, count(*) AS requests, least(count(*), CASE stage WHEN 'controlled_vocabulary' THEN 20 WHEN 'lexical' THEN 20 WHEN 'historical_terms' THEN 10 WHEN 'citation_expansion' THEN 25 WHEN 'semantic' THEN 15 WHEN 'related_works' THEN 10 ELSE 0 END) AS granted FROM r GROUP BY 1, 2")
def retrieval_cascade(t):
    """Requests of each search by stage of a cascade for high recall, and how many the stage may make."""
    stage = F.get(F.array(*map(F.lit, _STAGES)), (F.col("l_partkey") % 7).cast("int"))
    return ontology.granted(t("lineitem").select(F.col("l_quantity").cast("long").alias("search"), stage.alias("stage")))
