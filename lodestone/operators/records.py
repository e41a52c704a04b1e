"""Judgements on single records, on pairs of titles and on extractors' votes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, every, let, reference_ids, title_norm, word_tokens
from .graph import expanded, kinds, packed

# fixed values: what tells sections on problems and on methods
PROBLEM_HINTS = ("problem", "objective", "we seek", "we solve", "we consider", "estimate", "infer", "optimize", "simulate", "predict", "control", "reconstruct")
METHOD_HINTS = ("method", "algorithm", "procedure", "solver", "implementation", "numerical", "experimental setup")


def filled(c: Column, kind: str) -> Column:
    """Whether a field holds anything: null, an empty string and an empty array don't."""
    return F.coalesce(F.size(c) > 0 if kind == "array" else F.length(c) > 0, F.lit(False))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds n_filled, completeness (0 to 1) and missing (names, in the order given)."""
    kinds = {f: df.schema[f].dataType.typeName() for f in fields}
    has = {f: filled(F.col(f), kinds[f]) for f in fields}
    n = sum((has[f].cast("int") for f in fields), F.lit(0))
    missing = F.filter(F.array(*[F.when(~has[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return df.withColumn("n_filled", n).withColumn("completeness", F.round(n / len(fields), 6)).withColumn("missing", missing)


def ambiguity(task: Column, version: Column, confidence: Column, least: float = 0.5) -> Column:
    """Flags, in a fixed order, of records that need a second look."""
    flags = [(F.coalesce(task, F.lit("unknown")) == "unknown", "unknown task"), (F.coalesce(version, F.lit("")) == "", "version not pinned"), (F.coalesce(confidence < least, F.lit(True)), "low confidence")]
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in flags]), lambda x: x.isNotNull())


def evidence_span(c: Column, patterns: list[str], before: int = 180, after: int = 360) -> Column:
    """struct(start, end, pattern) around the first place of the first pattern that occurs, else null; start and end count characters from 0."""
    out = F.lit(None).cast("struct<start:int,end:int,pattern:string>")
    for p in reversed(patterns):
        at = F.instr(casefold(c), p) - 1
        span = F.struct(F.greatest(F.lit(0), at - before).alias("start"), F.least(F.length(c), at + len(p) + after).alias("end"), F.lit(p).alias("pattern"))
        out = F.when(at >= 0, span).otherwise(out)
    return out


#: fixed values, in the order tried: format, a part of the MIME type, a part of or whole names of the representation
FORMATS = [
    ("jats", "jats", ".*jats.*"),
    ("tei", "tei", ".*tei.*"),
    ("latex", "tex", "tex|latex|source"),
    ("html", "html", "html"),
    ("text", "text", "text|plain_text|abstract"),
]


def source_format(mime: Column, representation: Column) -> Column:
    """The parser for an asset: the first format that its type or representation fits; null if none does.

    "text/html" and "text/plain" hold "tex" and so count as LaTeX unless the caller
    gives a format, which is what the surveyed rule does.
    """
    m, r = casefold(F.coalesce(mime, F.lit(""))), casefold(F.coalesce(representation, F.lit("")))
    fits = [F.when(F.contains(m, F.lit(part)) | r.rlike(f"^({names})$"), F.lit(kind)) for kind, part, names in FORMATS]
    return F.coalesce(*fits)


def possible_identities(works: DataFrame, least: float = 0.82, years: int = 1) -> DataFrame:
    """works(id, title, year) -> left_id, right_id, score: pairs whose title words overlap by `least` or more.

    A pair whose known years differ by more than `years` counts half. Pairs meet at the
    rarest words of each title only: titles that overlap by `least` share one of the
    first n - ceil(least n) + 1 of their n words in order of rarity, so no such pair is lost.
    Works of equal words and year are met once, as a kind, and paired in the task that has their kinds.
    Titles without words have no pairs.
    """
    words = F.array_distinct(F.filter(F.split(title_norm(F.col("title")), " "), lambda x: x != ""))
    kind, own = kinds(works.select("id", "year", words.alias("words")).where(F.size("words") > 0), "id", ["words", "year"])
    t = kind.select(F.col("kind").alias("id"), "year", "words")
    w = t.select("id", F.explode("words").alias("word"))
    ranked = w.join(w.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    head = F.slice("r.word", 1, (F.size("r") - F.ceil(least * F.size("r") - 1e-9) + 1).cast("int"))
    t = t.join(ranked.select("id", head.alias("head")), "id")
    side = lambda s: t.select(F.struct("id", "year", "words", "head").alias(s), F.explode("head").alias("word"))
    a, b = side("a"), side("b")
    both = a.join(b, "word").where("a.id <= b.id").where(F.size("a.words") >= least * F.size("b.words") - 1e-9).where(F.size("b.words") >= least * F.size("a.words") - 1e-9)
    # a pair that meets at several words counts at the first
    both = both.where(F.array_intersect("a.head", "b.head")[0] == F.col("word"))
    score = F.size(F.array_intersect("a.words", "b.words")) / F.size(F.array_union("a.words", "b.words"))
    apart = F.coalesce(F.abs(F.col("a.year") - F.col("b.year")) > years, F.lit(False))
    scored = both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.when(apart, score * 0.5).otherwise(score).alias("score")).where(F.col("score") >= least)
    d = expanded(scored, packed(own.select("kind", F.col("id").alias("own"))), "{}")
    return d.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), F.round("score", 6).alias("score"))


def disagreement(votes: DataFrame) -> DataFrame:
    """votes(item, extractor, family) -> item, left, right, left_families, right_families: extractors that give an item unlike sets."""
    sets = votes.groupBy("item", "extractor").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    left = sets.select("item", F.col("extractor").alias("left"), F.col("families").alias("left_families"))
    right = sets.select("item", F.col("extractor").alias("right"), F.col("families").alias("right_families"))
    return left.join(right, "item").where("left < right AND left_families <> right_families")


def multiset_jaccard(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """left(id, tokens), right(id, tokens), pairs(left_id, right_id) -> the pairs with score, minima over maxima of token counts."""
    from ..functions.sets import weighted_jaccard
    from ..functions.text import multiset

    a = left.select(F.col("id").alias("left_id"), multiset(F.col("tokens")).alias("a"))
    b = right.select(F.col("id").alias("right_id"), multiset(F.col("tokens")).alias("b"))
    return pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", weighted_jaccard(F.col("a"), F.col("b")).alias("score"))


def intelligence(sections: Column, references: Column) -> Column:
    """struct of counts over sections(kind, text, equations), with how many hint at a problem or a method, how many are dense in equations, and warnings."""

    def told(own):
        # each section is read once
        hinted = lambda x, hints: reduce(or_, [F.contains(x, F.lit(h)) for h in hints])
        seen = F.transform(own, lambda s: let(casefold(s["text"]), lambda x: F.struct(F.size(word_tokens(s["text"])).alias("words"), hinted(x, PROBLEM_HINTS).alias("problem"), hinted(x, METHOD_HINTS).alias("method"), (s["equations"] >= 2).alias("dense"))))
        warnings = F.array_compact(F.array(F.when(F.size(own) == 0, F.lit("document contains no parsed sections")), F.when(references == 0, F.lit("document contains no parsed references"))))
        many = lambda z, c: F.size(F.filter(z, lambda s: s[c])).alias(f"{c}_sections")
        counts = lambda z: F.struct(F.size(z).alias("sections"), F.aggregate(z, F.lit(0), lambda a, s: a + s["words"]).alias("words"), many(z, "problem"), many(z, "method"), F.size(F.filter(z, lambda s: s["dense"])).alias("math_dense"), warnings.alias("warnings"))
        return let(seen, counts)

    return let(sections, told)


def reference(work: Column, place: Column, raw: Column) -> Column:
    """A reference row from its raw text."""
    return F.struct(work.alias("work_id"), place.alias("ord"), raw.alias("raw"), reference_ids(raw).alias("identifiers"))


def document_text(sections: Column) -> Column:
    """The sections with ink, a blank line between."""
    return F.array_join(F.transform(F.filter(sections, lambda s: F.trim(s["text"]) != ""), lambda s: s["text"]), "\n\n")


def token_set(c: Column) -> Column:
    """The distinct folded tokens of three characters or more."""
    return F.array_distinct(F.transform(every(c, r"[A-Za-z][A-Za-z0-9_-]{2,}"), casefold))
