"""PII: information-theoretic sanitisation on top of pattern matches.

Base spans are matches of four kinds of pattern (leftmost, not overlapping within a
kind, failing ones dropped). Their values are the protected entities. Terms are runs of
letters and digits of any length. Those that stand outside the base spans of a document
with an entity, anywhere in it, in MIN_TEXTS distinct texts at least, are candidates;
over all documents, P(entity | term) = documents with both / documents with the term, and
the information the term gives is log2 P(entity | term) / P(entity). Where
both exceed their thresholds the term discloses the entity and is a span of kind `term`
in every document, with or without an entity of its own. sanitise() generalises base spans to
their kind and removes terms.

Work on one text is linear in its length but for co-occurrence: places are running sums,
and what overlaps is told by the set of covered places, not by comparing each span with
each term. Entities and terms of a text meet as sets of the rows that hold them: a list of
thousands that stands in a few documents is a few sets. Terms too common for any
entity of a document don't meet its entities at all.

Defined cases: a null text is empty and has no span; ties in start go by kind as listed,
then end; a term that overlaps a base span is part of it and no span of its own; a row is
known by its doc_id and text, so rows that repeat both are answered once each and count
once each, rows that repeat the doc_id alone are documents of their own; null doc_ids are
kept; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cut import cut, sent

# Possessive and anchored at the start of a run (or where the last match ended), so that long runs cost their length once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]++"
MIN_TEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 6.0
CHUNK, BINS = 256, 64
NO_SPANS = "cast(array() AS array<struct<start: int, o: int, end: int, kind: string, value: string>>)"
NO_TERMS = "cast(array() AS array<struct<start: int, end: int, value: string>>)"


def _luhn(match: Column) -> Column:
    d = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(d))
    twice = lambda x: F.when(x > 9, x - 9).otherwise(x)
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(twice(F.substr(d, i, F.lit(1)).cast("int") * 2)))
    return F.length(d).between(14, 19) & (F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False)))


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(steps: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or what join makes of two values, from 0 on) of an array. Runs of CHUNK are joined apart, as growing one array by one copies it."""
    runs = _let(steps, lambda s: F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / CHUNK).cast("int")), lambda k: F.slice(s, k * CHUNK + 1, F.lit(CHUNK))))
    total = lambda r: F.aggregate(r, F.lit(0), join)
    grow = lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x)))
    begin = lambda rs: F.slice(F.aggregate(F.transform(rs, total), F.array(F.lit(0)), grow), F.lit(1), F.size(rs))
    within = lambda r, o: F.slice(F.aggregate(r, F.array(o), grow), 2, CHUNK)
    return _let(runs, lambda rs: F.flatten(F.zip_with(rs, begin(rs), within)))


def _placed(words: Column, between: Column) -> Column:
    """(start, end, value) of each word, from the words and what stands between them."""
    gap = F.zip_with(F.slice(between, F.lit(1), F.size(words)), F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.size(words) - 1)), lambda b, w: F.length(b) + F.length(w))
    return F.zip_with(words, _running(gap), lambda w, s: F.struct(s.alias("start"), (s + F.length(w)).alias("end"), w.alias("value")))


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches of a pattern."""
    some = lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda b: _placed(m, b))).otherwise(F.expr(NO_TERMS))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _spans(text: Column, kind: str, pattern: str, hint: str | None, order: int) -> Column:
    """Spans of one kind, those that pass its test."""
    told = lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("o"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
    some = text.contains(hint) if hint else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(some, F.filter(F.transform(_matches(text, pattern), told), lambda s: _passes(kind, s["value"]))).otherwise(F.expr(NO_SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> the same with no null text, and spans in order of start, then kind."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumn("spans", F.array_sort(F.concat(*[_spans(F.col("text"), k, p, h, i) for i, (k, p, h) in enumerate(KINDS)])))


def _apart(words: Column, spans: Column) -> Column:
    """Those of the placed words that overlap no span."""

    def some(w):
        gap = lambda x, i: x["start"] - F.when(i > 0, F.get(w, i - 1)["end"]).otherwise(0)
        # which word holds each place of the text, -1 for none
        owner = F.flatten(F.transform(w, lambda x, i: F.concat(F.array_repeat(F.lit(-1), gap(x, i)), F.array_repeat(i, x["end"] - x["start"]))))
        covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))
        met = _let(owner, lambda o: F.array_distinct(F.transform(covered, lambda p: F.get(o, p))))
        left = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), met)
        return F.when((F.size(w) > 0) & (F.size(spans) > 0), F.transform(left, lambda i: F.get(w, i))).otherwise(w)

    return _let(words, some)


def _among(words: Column, own: Column) -> Column:
    """Those of the placed words whose lower case is in own; of a long list they meet only one of BINS parts each."""
    bin_of = lambda x: F.pmod(F.xxhash64(x), F.lit(BINS)).cast("int")
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.filter(own, lambda x: bin_of(x) == i))
    short = F.filter(words, lambda w: F.array_contains(own, F.lower(w["value"])))
    long = _let(bins, lambda z: F.filter(words, lambda w: F.array_contains(F.get(z, bin_of(F.lower(w["value"]))), F.lower(w["value"]))))
    return F.when(F.size(own) <= BINS, short).otherwise(long)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds k, which is the same for rows of one doc_id and text."""
    own = F.coalesce(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("n"))
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.md5(F.concat(own, F.lit(":"), "text")))


def disclosing_terms(docs: DataFrame, found: DataFrame, total: int, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> tuple[DataFrame, DataFrame]:
    """docs(k, text), all rows; found(k, m, text, spans), distinct rows with spans and how often each is met -> (terms, held).

    terms: term, entity, bits, those beyond both thresholds, for each number of shared documents the rarest entity;
    held: k, term, for each row and term that may be one of them.
    Entities that stand in the same rows are one, and so are terms: a document with many of both makes a row for each
    two of their sets of rows, not for each two of them.
    """
    found = found.withColumn("t", F.md5("text"))
    # which rows hold an entity or a term, as a number for the set
    held_by = [F.bit_xor(F.xxhash64(F.lit(i), "k")) for i in (1, 2)]
    e = found.select("k", "m", "t", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))).alias("entity"))
    # no term has a share above 1, so an entity in too few texts or too many documents has no term
    with_entity = e.groupBy("entity").agg(F.sum("m").alias("de"), F.count_distinct("t").alias("texts"), held_by[0].alias("e1"), held_by[1].alias("e2")).where((F.col("texts") >= min_texts) & (F.log2(F.lit(float(max(1, total))) / F.col("de")) >= min_bits)).drop("texts")
    e = cut(e.select("k", "entity").join(with_entity, "entity").groupBy("k", "e1", "e2", "de").agg(F.min("entity").alias("entity")))
    text = found.join(sent(cut(e.groupBy("k").agg(F.max("de").alias("most")))), "k")
    named = F.transform(_apart(_matches(F.col("text"), TERM), F.col("spans")), lambda w: F.lower(w["value"]))
    near = cut(text.select("k", "m", "t", "most", F.explode(F.array_distinct(named)).alias("term")))
    # documents with such an entity that hold a term are some of those that hold it, so a share that is too small of them is too small of all
    about = near.groupBy("term").agg(F.sum("m").alias("least_df"), F.count_distinct("t").alias("texts"), F.max("most").alias("most"), held_by[0].alias("t1"), held_by[1].alias("t2"))
    about = cut(about.where((F.col("texts") >= min_texts) & (F.col("most") >= F.col("least_df") * min_share)).select("term", "least_df", "t1", "t2"))
    sets = near.join(sent(about), "term").where(F.col("most") >= F.col("least_df") * min_share).select("k", "m", "t", "t1", "t2", "least_df").distinct()
    both = sets.join(e, "k").where(F.col("de") >= F.col("least_df") * min_share)
    group = ["t1", "t2", "e1", "e2", "de", "least_df"]
    pairs = both.groupBy(*group, "t").agg(F.sum("m").alias("n"), F.min("entity").alias("entity")).groupBy(*group).agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("entity").alias("entity"))
    # of the entities that as many documents share with a term, the rarest tells most
    best = cut(pairs.where((F.col("texts") >= min_texts) & (F.col("n") >= F.col("least_df") * min_share)).groupBy("t1", "t2", "n").agg(F.min(F.struct("de", "entity")).alias("x")).select("t1", "t2", "n", "x.de", "x.entity"))
    pairs = cut(about.join(sent(best), ["t1", "t2"]).select("term", "entity", "de", "n"))
    names = sent(cut(pairs.select("term").distinct()))
    words = docs.select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    held = cut(words.join(names, "term"))
    share = F.col("n") / F.col("df")
    told = pairs.join(held.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("bits", F.log2(share / (F.col("de") / F.lit(float(max(1, total))))))
    return told.where((share >= min_share) & (F.col("bits") >= min_bits)).select("term", "entity", "bits"), held


def find(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), **thresholds) -> DataFrame:
    """docs(doc_id, text) -> the columns, spans (base), terms (start, end, value): one row for each row of docs. thresholds: those of disclosing_terms."""
    every = _keyed(docs, "doc_id")
    based = base_spans(every.select("k", "text")).where(F.size("spans") > 0)
    found = cut(based.groupBy("k").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("m")))
    terms, held = disclosing_terms(every.select("k", "text"), found, docs.count(), **thresholds)
    terms = sent(cut(terms.select("term").distinct()))
    # places are worked out only for the documents that hold a term
    holders = sent(cut(held.join(terms, "term", "left_semi").groupBy("k").agg(F.collect_set("term").alias("own"))))
    d = base_spans(every.select("k", "text").join(holders, "k"))
    placed = d.select("k", _among(_apart(_matches(F.col("text"), TERM), F.col("spans")), F.col("own")).alias("terms"))
    extra = placed.groupBy("k").agg(F.first("terms").alias("terms"))
    told = cut(found.select("k", "spans").join(extra, "k", "full"))
    known = _keyed(docs, *[c for c in columns if c != "text"]) if "text" not in columns else _keyed(docs, *[c for c in columns if c != "text"], F.col("text").alias("given"))
    known = known.drop("text").join(sent(told), "k", "left")
    own = [F.col("given").alias("text") if c == "text" else F.col(c) for c in columns]
    return known.select(*own, F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"), F.coalesce("terms", F.expr(NO_TERMS)).alias("terms"))


def _all_spans() -> Column:
    """Base spans and terms, in order."""
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("o"), t["end"].alias("end"), F.lit("term").alias("kind"), t["value"].alias("value")))
    return F.array_sort(F.concat("spans", terms))


def told(found: DataFrame) -> DataFrame:
    """The digest of find(): counts, base_sha256 and spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    many = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[many(k) for k, _, _ in KINDS], F.sha2(F.array_join(F.transform("spans", line), ","), 256).alias("base_sha256"), F.array_join(F.transform(_all_spans(), line), ",").alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text: base spans generalised to their kind, terms removed. Spans that overlap become one, named by the first."""
    d = find(docs, ("doc_id", "text"), **thresholds).withColumn("s", _all_spans())

    def cleaned(spans):
        until = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        heads = _let(until, lambda u: F.filter(spans, lambda s, i: (i == 0) | (s["start"] >= F.get(u, i - 1))))
        name = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        put = F.transform(heads, lambda s: F.struct(s["start"].alias("at"), name(s).alias("t")))
        covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.length("text") - 1), covered)
        chars = _let(F.split("text", ""), lambda c: F.transform(kept, lambda p: F.struct(p.alias("at"), F.get(c, p).alias("t"))))
        return F.array_join(F.transform(F.array_sort(F.concat(put, chars)), lambda x: x["t"]), "")

    return d.select("doc_id", F.when(F.size("s") > 0, _let(F.col("s"), cleaned)).otherwise(F.col("text")).alias("text"))
