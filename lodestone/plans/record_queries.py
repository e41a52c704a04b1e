"""Queries on records, titles and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records as op
from .graph_queries import RECORDS, records
from .registry import query
from .text_queries import FORMULA, _formula

FIELDS = ["math", "operator", "constraint", "topology", "method", "lexical"]
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN len(\"{f}\") = 0 THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL)"
PATTERNS = ["graph", "quer", "ation", "the "]  # fixed values: stems of the supplied texts
_MIME = "CASE p_size % 7 WHEN 0 THEN 'application/jats+xml' WHEN 1 THEN 'application/tei+xml' WHEN 2 THEN 'application/x-tex' WHEN 3 THEN 'text/html' WHEN 4 THEN 'text/plain' WHEN 5 THEN 'application/xhtml' END"
_REP = "CASE p_size % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'Scan' END"


@query(f"WITH {RECORDS}, m AS (SELECT id, {_MISSING} AS m FROM rec) SELECT id, CAST(6 - len(m) AS INTEGER) AS n_filled, round((6 - len(m)) / 6.0::DOUBLE, 6) AS completeness, array_to_string(m, '|') AS missing FROM m")
def problem_completeness(t):
    """How many fields of any record are filled, and which aren't."""
    return op.completeness(records(t), FIELDS).select("id", "n_filled", "completeness", F.array_join("missing", "|").alias("missing"))


@query(f"WITH {RECORDS} SELECT id, array_to_string(list_filter([CASE WHEN task = 't0' THEN 'unknown task' END, CASE WHEN len(topology) = 0 THEN 'version not pinned' END, CASE WHEN len(lexical) / 40.0::DOUBLE < 0.5 THEN 'low confidence' END], lambda x: x IS NOT NULL), '|') AS flags FROM rec")
def problem_flags(t):
    """Flags of ambiguous records."""
    task = F.when(F.col("task") == "t0", "unknown").otherwise(F.col("task"))
    return records(t).select("id", F.array_join(op.ambiguity(task, F.array_join("topology", ""), F.size("lexical") / 40), "|").alias("flags"))


_AT = ", ".join(f"strpos(replace(lower(text), 'ß', 'ss'), '{p}') AS p{i}" for i, p in enumerate(PATTERNS))
_WHICH = "CASE " + " ".join(f"WHEN p{i} > 0 THEN {{{i}}}" for i in range(len(PATTERNS))) + " END"
_PLACE = _WHICH.format(*[f"p{i} - 1" for i in range(len(PATTERNS))])
_NAME = _WHICH.format(*[f"'{p}'" for p in PATTERNS])


@query(f"WITH d AS (SELECT doc_id, text, {_AT} FROM documents), e AS (SELECT doc_id, text, {_PLACE} AS pos, {_NAME} AS pattern FROM d) SELECT doc_id, pattern, CAST(greatest(0, pos - 180) AS INTEGER) AS start_char, CAST(least(length(text), pos + length(pattern) + 360) AS INTEGER) AS end_char, md5(substr(text, greatest(0, pos - 180) + 1, least(length(text), pos + length(pattern) + 360) - greatest(0, pos - 180))) AS quote_md5 FROM e WHERE pattern IS NOT NULL")
def evidence_span(t):
    """The surroundings of the first pattern that a text holds."""
    d = t("documents").select("doc_id", "text", op.evidence_span(F.col("text"), PATTERNS).alias("s")).where("s IS NOT NULL")
    quote = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return d.select("doc_id", F.col("s.pattern").alias("pattern"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.md5(quote).alias("quote_md5"))


@query(f"WITH a AS (SELECT p_partkey, coalesce({_MIME}, '') AS m, lower(coalesce({_REP}, '')) AS r FROM part) SELECT p_partkey, CASE WHEN m LIKE '%jats%' THEN 'jats' WHEN m LIKE '%tei%' THEN 'tei' WHEN m LIKE '%tex%' OR r IN ('tex', 'latex', 'source') THEN 'latex' WHEN m LIKE '%html%' OR r = 'html' THEN 'html' WHEN m LIKE '%text%' OR r IN ('text', 'plain_text', 'abstract') THEN 'text' END AS format FROM a")
def source_format(t):
    """B2: the parser of an asset by its type, then its representation."""
    return t("part").select("p_partkey", op.source_format(F.expr(_MIME), F.expr(_REP)).alias("format"))


@query("WITH w AS (SELECT p_partkey AS id, p_size AS y, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), s AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE * CASE WHEN abs(a.y - b.y) > 1 THEN 0.5 ELSE 1 END AS score FROM w a JOIN w b ON a.id < b.id) SELECT left_id, right_id, round(score, 6) AS score FROM s WHERE score >= 0.82")
def possible_identity(t):
    """Pairs of titles that overlap, in like years."""
    return op.possible_identities(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year")))


@query("WITH s AS (SELECT o_custkey AS item, o_orderpriority AS e, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS f FROM orders GROUP BY 1, 2) SELECT a.item, a.e AS \"left\", b.e AS \"right\", a.f AS left_families, b.f AS right_families FROM s a JOIN s b ON a.item = b.item AND a.e < b.e AND a.f <> b.f")
def extractor_disagreement(t):
    """Pairs of extractors that give one item unlike families."""
    return op.disagreement(t("orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("extractor"), F.col("o_orderstatus").alias("family")))


@query(f"WITH f AS (SELECT p_partkey AS k, unnest(regexp_extract_all({FORMULA}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]')) AS t FROM part), n AS (SELECT k, t, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT a.p_partkey AS l, b.p_partkey AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), u AS (SELECT l, r, t, n AS x, 0 AS y FROM p JOIN n ON k = l UNION ALL SELECT l, r, t, 0, n FROM p JOIN n ON k = r), g AS (SELECT l, r, t, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1, 2, 3) SELECT l AS left_id, r AS right_id, round(sum(least(x, y))::DOUBLE / sum(greatest(x, y))::DOUBLE, 6) AS score FROM g GROUP BY 1, 2")
def formula_multiset_jaccard(t):
    """Token counts of each formula against the next one's."""
    d = t("part").select(F.col("p_partkey").alias("id"), text.every(_formula(), r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]").alias("tokens"))
    ids = d.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    return op.multiset_jaccard(d, d, ids).withColumn("score", F.round("score", 6))
