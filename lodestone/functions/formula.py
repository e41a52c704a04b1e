"""Formulas: features, fingerprints and their comparison, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import jaccard, weighted_jaccard
from .text import alpha_normalize, collapse, every, latex_tokens, multiset, relation

# fixed values: operators and the strings that hint at them
HINTS = {
    "sum": ("\\sum",),
    "product": ("\\prod",),
    "integral": ("\\int", "\\oint"),
    "derivative": ("\\partial", "\\frac{d", "\\nabla"),
    "expectation": ("\\mathbb{E}", "\\operatorname{E}"),
    "norm": ("\\lVert", "\\|"),
    "inner_product": ("\\langle",),
    "matrix": ("\\begin{matrix}", "\\begin{bmatrix}", "\\begin{pmatrix}"),
    "tensor_product": ("\\otimes",),
    "commutator": ("[", "]"),
    "eigenproblem": ("\\lambda",),
}
# fixed values: what tells an inequality, and probability in lower case
INEQUALITY, PROBABILITY = ("<", ">", "\\le", "\\ge"), ("prob", "\\mathbb{p}", "expect")
# fixed values: weights of the views of two formulas
WEIGHTS = {"exact": 0.15, "alpha": 0.30, "token": 0.25, "operator": 0.20, "relation": 0.10}


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike("|".join(re.escape(p) for p in parts))


def operators(c: Column) -> Column:
    """Sorted names of the operators that are hinted at."""
    return F.array_compact(F.array(*[F.when(_any(c, HINTS[k]), F.lit(k)) for k in sorted(HINTS)]))


def features(c: Column) -> Column:
    """struct of sorted commands, single-letter symbols and operators, and four flags; a null formula is empty."""
    c = F.coalesce(c, F.lit(""))
    found = operators(c)
    return F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\([A-Za-z]+)"), F.lit(1)))).alias("commands"),
        F.array_sort(F.array_distinct(every(c, r"(?<!\\)\b[A-Za-z]\b"))).alias("symbols"),
        found.alias("operators"),
        F.contains(c, F.lit("=")).alias("has_equality"),
        _any(c, INEQUALITY).alias("has_inequality"),
        _any(F.lower(c), PROBABILITY).alias("has_probability"),
        F.arrays_overlap(found, F.array(F.lit("matrix"), F.lit("tensor_product"))).alias("has_matrix"),
    )


def fingerprint(c: Column) -> Column:
    """struct(exact, alpha, tokens, operators, relation, depth): hashes of the spelling and of the form with names renamed, and the views compared."""
    full = F.coalesce(c, F.lit(""))
    tokens = latex_tokens(full)
    told = relation(tokens)["name"]
    return F.struct(
        F.sha2(collapse(full), 256).alias("exact"),
        F.when(F.length(c) > 0, F.sha2(alpha_normalize(c), 256)).alias("alpha"),
        multiset(tokens).alias("tokens"),
        operators(full).alias("operators"),
        told.alias("relation"),
        F.when(told.isNotNull(), 2).otherwise(1).alias("depth"),
    )


def compare(a: Column, b: Column) -> Column:
    """struct of the agreement of two fingerprints in each view, and their weighted sum."""
    same = lambda x, y: F.coalesce((x == y).cast("double"), F.lit(0.0))
    views = {
        "exact": same(a["exact"], b["exact"]),
        "alpha": same(a["alpha"], b["alpha"]),
        "token": weighted_jaccard(a["tokens"], b["tokens"]),
        "operator": jaccard(a["operators"], b["operators"]),
        "relation": same(a["relation"], b["relation"]),
    }
    score = sum((views[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in views.items()], score.alias("score"))
