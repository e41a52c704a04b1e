"""Problem extraction, quality and admission queries, with SQL that searches pattern by pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import problems as op
from .registry import query

# what the texts of the tables lack: sentences of the field, put before and behind the text of a document by its id
SAID = [
    "Nothing is asked here.",
    "We Minimiz a convex loss. then the posterior of a sparse graph is inferred? Yes.",
    "A shortest  path in the NETWORK; Monte Carlo sampling of the density! no more",
    "Eigenvalues of a low-rank symmetric matrix. Matrix-vector products, a linear solve.",
    "the ODE has a phase space. Its trajectory is predicted by an integrator with a time step.",
    "Rare-event simulation, partition function, quadrature: high dimensional and periodic.",
    "Schedule under constraint satisfaction.  gradient descent forecasts the tensor.",
    "We reconstruct from tomography. An optimal control policy of the Markov chain with locality.",
]
_SAID = "[" + ", ".join("'" + s + "'" for s in SAID) + "]"
_PARTS = f"[({_SAID})[doc_id % 8 + 1], coalesce(text, ''), ({_SAID})[doc_id // 3 % 8 + 1] || chr(10) || ' tail.']"


def _docs(t):
    said = F.array(*map(F.lit, SAID))
    parts = F.array(F.get(said, F.col("doc_id") % 8), F.coalesce("text", F.lit("")), F.concat(F.get(said, F.call_function("div", "doc_id", F.lit(3)) % 8), F.lit("\n tail.")))
    sections = F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), x.alias("text")))
    return t("documents").select(F.col("doc_id").alias("work_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("asset_id"), sections.alias("sections"), F.split(F.coalesce("text", F.lit("")), "\n").alias("equations"))


def _lexicon(name: str, lexicon: dict[str, tuple[str, ...]]) -> str:
    rows = [f"('{n}', {i}, {k}, '{p}')" for i, (n, patterns) in enumerate(lexicon.items()) for k, p in enumerate(patterns)]
    return f"{name}(name, o, k, p) AS (VALUES {', '.join(rows)})"


_FOLD = "replace(lower({}), 'ß', 'ss')"
_NAMES = "(SELECT list(name ORDER BY ord) FROM (SELECT DISTINCT name, o AS ord FROM {} WHERE contains(d.f, p)))"
_EXTRACT = f"""WITH {_lexicon('fam', op.FAMILIES)}, {_lexicon('ops', op.OPERATIONS)}, {_lexicon('str', op.STRUCTURES)}, {_lexicon('obj', op.OBJECTS)},
s AS (SELECT doc_id, unnest(range(3)) AS i, unnest({_PARTS}) AS x FROM documents), ink AS (SELECT *, {_FOLD.format('x')} AS f FROM s WHERE trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
w AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS x FROM ink GROUP BY doc_id), d AS (SELECT doc_id, x, {_FOLD.format('x')} AS f FROM w),
said AS (SELECT doc_id, unnest(range(len(q))) AS n, unnest(q) AS q FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS q FROM d)),
told AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place FROM (SELECT DISTINCT doc_id, name, o AS ord FROM d JOIN fam ON contains(f, p)) QUALIFY place < 3),
quote AS (SELECT doc_id, name, arg_min(q, n) AS q FROM told JOIN said USING (doc_id) JOIN fam USING (name) WHERE contains({_FOLD.format('q')}, p) GROUP BY 1, 2),
hit AS (SELECT doc_id, name, i, x, p, strpos(f, p) - 1 AS z, row_number() OVER (PARTITION BY doc_id, name ORDER BY i, k) AS r FROM told JOIN ink USING (doc_id) JOIN fam USING (name) WHERE contains(f, p) QUALIFY r = 1),
l AS (SELECT doc_id, coalesce({_NAMES.format('ops')}, []) AS o, coalesce({_NAMES.format('str')}, []) AS s, coalesce({_NAMES.format('obj')}, []) AS m FROM d) """


@query(_EXTRACT + """SELECT doc_id AS work_id, CAST(place AS INTEGER) AS place, name AS task_family, substr(q, 1, 700) AS statement, array_to_string(m, '|') AS objects, array_to_string(l.s, '|') AS structures, array_to_string(o, '|') AS operations,
's' || i AS section_id, CAST(greatest(0, z - 180) AS INTEGER) AS start_char, CAST(least(length(x), z + length(p) + 360) AS INTEGER) AS end_char, md5(substr(x, greatest(0, z - 180) + 1, least(length(x), z + length(p) + 360) - greatest(0, z - 180))) AS span_md5, 'keyword:' || p AS rule, round(least(0.55, 0.2 + 0.05 * len(o) + 0.04 * len(l.s)), 6) AS confidence
FROM told JOIN quote USING (doc_id, name) JOIN hit USING (doc_id, name) JOIN l USING (doc_id)""")
def problem_extraction(t):
    """The first three families of each document with quote, span, operations, structures, objects and confidence."""
    listed = [F.array_join(c, "|").alias(n) for c, n in (("mathematical_objects", "objects"), ("structural_properties", "structures"), ("algorithmic_operations", "operations"))]
    return op.extract(_docs(t)).select("work_id", "place", "task_family", "statement", *listed, "span.section_id", "span.start_char", "span.end_char", F.md5("span.text").alias("span_md5"), "span.rule", F.round("confidence", 6).alias("confidence"))


@query(_EXTRACT + ", n AS (SELECT doc_id, count(*) AS n FROM told GROUP BY 1) SELECT doc_id AS work_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS equation_count, CAST(coalesce(n, 0) AS INTEGER) AS problems, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'unknown work: ' || doc_id WHEN doc_id % 5 = 0 THEN 'asset belongs to ' || (doc_id + 1) END AS error FROM documents LEFT JOIN n USING (doc_id)")
def canonical_processing(t):
    """M4, M5: equations and problems of assets whose work is known and that no other work owns; of the others, why they are refused. Works are the labelled documents; every fifth asset is another work's."""
    docs = _docs(t)
    stored = docs.where("work_id % 5 = 0").select("asset_id", (F.col("work_id") + 1).alias("work_id"))
    told = op.admitted(docs, t("labels").select(F.col("doc_id").alias("work_id")), stored)
    done = op.process(docs).select("work_id", "equation_count", F.size("problem_ids").alias("problems"))
    return told.select("work_id", "error").join(done, "work_id").select("work_id", "equation_count", "problems", "error")


_FIELDS = {
    "inputs": ("string_split(p_name, ' ')[:p_size % 3]", "array"), "outputs": ("CASE WHEN p_size % 5 > 0 THEN [p_brand] END", "array"), "objective": ("CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_type END", "text"), "constraints": ("[]::VARCHAR[]", "array"),
    "access_model": ("CASE WHEN p_partkey % 3 = 0 THEN p_type END", "text"), "mathematical_objects": ("string_split(p_name, ' ')[:p_partkey % 2]", "array"), "known_methods": ("CASE WHEN p_size > 25 THEN [p_brand] END", "array"), "evidence": ("[p_brand]", "array"), "assumptions": ("CASE WHEN p_size % 7 > 3 THEN [p_brand] END", "array"),
}
_HAS = {f: f"coalesce({'len' if kind == 'array' else 'length'}({sql}), 0) > 0" for f, (sql, kind) in _FIELDS.items()}


def _missing(fields):
    return "list_filter([" + ", ".join(f"CASE WHEN NOT ({_HAS.get(f, 'false')}) THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL)"


def _records(t):
    name, none = F.split("p_name", " "), F.array().cast("array<string>")
    return t("part").select(
        "p_partkey", F.slice(name, 1, F.col("p_size") % 3).alias("inputs"), F.when(F.col("p_size") % 5 > 0, F.array("p_brand")).alias("outputs"), F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, F.col("p_type")).alias("objective"), none.alias("constraints"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("access_model"), F.slice(name, 1, (F.col("p_partkey") % 2).cast("int")).alias("mathematical_objects"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("known_methods"), F.array("p_brand").alias("evidence"), F.when(F.col("p_size") % 7 > 3, F.array("p_brand")).alias("assumptions"),
        F.slice(F.array(*map(F.lit, ("inputs", "evidence", "objective", "inputs", "outputs"))), 1, F.col("p_size") % 6).alias("evidence_fields"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("source_version_id"), F.when(F.col("p_size") % 9 > 0, F.col("p_type")).otherwise("unknown").alias("task_family"), (F.col("p_size") / 50).alias("confidence"),
    )


@query(f"SELECT p_partkey, CAST(16 - len(m) AS INTEGER) AS filled_fields, (16 - len(m)) / 16.0::DOUBLE AS score, array_to_string(m, '|') AS missing FROM (SELECT p_partkey, {_missing(op.EXPECTED)} AS m FROM part)")
def record_completeness(t):
    """Which of the sixteen expected fields a problem fills."""
    return op.completeness(_records(t)).select("p_partkey", "filled_fields", "score", F.array_join("missing", "|").alias("missing"))


@query(f"SELECT p_partkey, round((8 - len(m)) / 8.0::DOUBLE, 6) AS completeness, array_to_string(m, '|') AS missing, round(([0, 1, 1, 2, 2, 3])[p_size % 6 + 1] / 8.0::DOUBLE, 6) AS evidence_coverage, array_to_string(list_filter([CASE WHEN p_size % 9 = 0 THEN 'unknown task family' END, CASE WHEN p_size % 2 = 1 THEN 'source version not pinned' END, CASE WHEN p_size < 25 THEN 'low overall extraction confidence' END], lambda x: x IS NOT NULL), '|') AS flags FROM (SELECT p_partkey, p_size, {_missing(op.HIGH_VALUE)} AS m FROM part)")
def problem_quality(t):
    """Completeness and evidence over the eight fields of high value, and what makes a problem ambiguous."""
    return op.quality(_records(t)).select("p_partkey", "completeness", F.array_join("missing", "|").alias("missing"), "evidence_coverage", F.array_join("ambiguity_flags", "|").alias("flags"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(concat_ws(' ', 'The ' || p_name || ' and that', CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_type END, array_to_string(string_split(p_name, ' ')[:p_size % 3], ' '), CASE WHEN p_size % 5 > 0 THEN p_brand END), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: replace(lower(x), 'ß', 'ss')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this')))), '|') AS tokens FROM part")
def lexical_view(t):
    """The distinct folded words of a problem's statement, objective, inputs, outputs and constraints, without seven stop words."""
    said = F.concat_ws(" ", F.concat(F.lit("The "), "p_name", F.lit(" and that")), "objective", F.array_join("inputs", " "), F.array_join("outputs", " "), F.array_join("constraints", " "))
    d = _records(t).join(t("part").select("p_partkey", "p_name"), "p_partkey")
    return d.select("p_partkey", F.array_join(F.array_sort(text.lexical_tokens(said)), "|").alias("tokens"))
