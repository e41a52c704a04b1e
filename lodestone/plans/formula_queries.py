"""Formulas of parts: features, fingerprints and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula
from .registry import query

#: '~' stands for a backslash, which the two dialects write unlike
TEX = "replace(CASE p_partkey % 6 WHEN 0 THEN '~sum_i a_i  x^2 = ' || p_size % 4 WHEN 1 THEN '~int f(x) dx <= ~lambda ~| v' || p_size % 3 WHEN 2 THEN '[A, B] == ' || p_name WHEN 3 THEN 'Prob(X > ' || p_size % 5 || ') ~ge 0.5' WHEN 4 THEN '~begin{bmatrix} a & b ~end{bmatrix} v = ~left( w' ELSE split_part(p_name, ' ', 1) || ' + y = 1' END, '~', chr(92))"
_HINT = lambda name, *parts: f"CASE WHEN {' OR '.join(f'contains(x, replace({p!r}, chr(126), chr(92)))' for p in parts)} THEN '{name}' END"
_OPS = "list_filter([" + ", ".join([_HINT("commutator", "[", "]"), _HINT("eigenproblem", "~lambda"), _HINT("integral", "~int", "~oint"), _HINT("matrix", "~begin{matrix}", "~begin{bmatrix}", "~begin{pmatrix}"), _HINT("norm", "~lVert", "~|"), _HINT("sum", "~sum")]) + "], lambda o: o IS NOT NULL)"
_TOKENS = r"regexp_extract_all(x, '\\[A-Za-z]+|[A-Za-z][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|==|<=|>=|!=|[-+*/^_=<>()\[\]{},]')"
_F = f"WITH f AS (SELECT p_partkey AS k, {TEX} AS x FROM part), o AS (SELECT *, {_OPS} AS ops, {_TOKENS} AS tok FROM f)"
_REL = "CASE WHEN list_contains(tok, '=') THEN 'equals' WHEN list_contains(tok, '<=') THEN 'le' WHEN list_contains(tok, '>=') THEN 'ge' WHEN list_contains(tok, '<') THEN 'lt' WHEN list_contains(tok, '>') THEN 'gt' END"
_SIGN = "CASE WHEN list_contains(tok, '=') THEN '=' WHEN list_contains(tok, '<=') THEN '<=' WHEN list_contains(tok, '>=') THEN '>=' WHEN list_contains(tok, '<') THEN '<' WHEN list_contains(tok, '>') THEN '>' END"


def _formulas(t):
    return t("part").select(F.col("p_partkey").alias("k"), F.expr(TEX).alias("x"))


@query(_F + r""" SELECT k, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\([A-Za-z]+)', 1))), ' ') AS commands,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '\\?\b[A-Za-z]\b'), lambda s: NOT starts_with(s, chr(92))))), ' ') AS symbols, array_to_string(ops, ' ') AS operators, contains(x, '=') AS has_equality,
  contains(x, '<') OR contains(x, '>') OR contains(x, chr(92) || 'le') OR contains(x, chr(92) || 'ge') AS has_inequality, contains(lower(x), 'prob') AS has_probability, list_contains(ops, 'matrix') AS has_matrix FROM o""")
def math_features(t):
    """Commands, symbols, hinted operators and flags of each formula."""
    d = _formulas(t).select("k", formula.features(F.col("x")).alias("f"))
    listed = [F.array_join(f"f.{c}", " ").alias(c) for c in ("commands", "symbols", "operators")]
    return d.select("k", *listed, *[f"f.{c}" for c in ("has_equality", "has_inequality", "has_probability", "has_matrix")])


@query(_F + f", r AS (SELECT *, {_REL} AS rel, {_SIGN} AS sign FROM o), c AS (SELECT k, string_agg(t || '=' || n, ' ' ORDER BY t) AS tokens FROM (SELECT k, t, count(*) AS n FROM (SELECT k, unnest(tok) AS t FROM o) GROUP BY k, t) GROUP BY k) SELECT k, sha256(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS exact, tokens, array_to_string(ops, ' ') AS operators, rel AS relation, CASE WHEN rel IS NULL THEN 1 ELSE 2 END AS depth, CASE WHEN rel IS NOT NULL THEN array_to_string(tok[1:list_position(tok, sign) - 1], ' ') END AS left_side FROM r JOIN c USING (k)")
def math_fingerprint(t):
    """The hash of the spelling, the multiset of tokens, operators, and the relation with what stands before it."""
    from ..functions import text

    d = _formulas(t).select("k", formula.fingerprint(F.col("x")).alias("f"), text.relation(text.latex_tokens(F.col("x"))).alias("r"))
    told = F.array_join(F.transform(F.map_entries("f.tokens"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    return d.select("k", "f.exact", told.alias("tokens"), F.array_join("f.operators", " ").alias("operators"), "f.relation", "f.depth", F.col("r.left").alias("left_side"))


@query(_F + f""", r AS (SELECT *, {_REL} AS rel, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS flat FROM o),
n AS (SELECT k, t, count(*) AS n FROM (SELECT k, unnest(tok) AS t FROM o) GROUP BY k, t),
j AS (SELECT a.k AS k, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / sum(greatest(coalesce(x.n, 0), coalesce(y.n, 0)))::DOUBLE AS token FROM r a, LATERAL (SELECT DISTINCT t FROM n WHERE n.k IN (a.k, a.k + 6)) u LEFT JOIN n x ON x.k = a.k AND x.t = u.t LEFT JOIN n y ON y.k = a.k + 6 AND y.t = u.t GROUP BY a.k)
SELECT a.k AS k, round(token, 6) AS token, round(CASE WHEN len(list_distinct(list_concat(a.ops, b.ops))) > 0 THEN len(list_intersect(a.ops, b.ops)) / len(list_distinct(list_concat(a.ops, b.ops)))::DOUBLE ELSE 0 END, 6) AS operator,
  a.flat = b.flat AS exact, coalesce(a.rel = b.rel, false) AS relation FROM r a JOIN r b ON b.k = a.k + 6 JOIN j ON j.k = a.k""")
def math_compare(t):
    """Each formula against the sixth after it, view by view."""
    d = _formulas(t).select("k", formula.fingerprint(F.col("x")).alias("f"))
    other = d.select((F.col("k") - 6).alias("k"), F.col("f").alias("g"))
    c = d.join(other, "k").select("k", formula.compare(F.col("f"), F.col("g")).alias("c"))
    return c.select("k", F.round("c.token", 6).alias("token"), F.round("c.operator", 6).alias("operator"), (F.col("c.exact") == 1).alias("exact"), (F.col("c.relation") == 1).alias("relation"))
