"""Benchmark decontamination: a hash set of normalised test n-grams against training windows.

A window is `size` consecutive benchmark words; a shorter item is one window. Any
stretch of m words holds exactly one g-word gram that starts at a multiple of
m - g + 1, so documents are probed at those places only, for all lengths of window in
one pass over the words. A probe that meets a gram of the benchmark is widened to the few
windows around it, whose hash and then whose words are compared. While the grams, as
measured, stay under a size, they go to every task and the scan runs from probe to window
within one stage. Beyond it, probes of constant size (ids, place and hash) meet the
grams by shuffle, dealt by salt as one gram may stand in a third of all texts, and only
documents that hold a gram are read again. No text is shuffled.

Defined cases: a null text has no words, nor windows; a null item_id is left out of
items_sha256 and n_items but its windows count as hits; repeated benchmark rows count
once; a document row is known by its doc_id and text, so rows that repeat both get the
same answer each, rows that repeat the doc_id alone are judged by themselves, null
doc_ids included; an empty benchmark hits nothing; empty documents give an empty result;
other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cut import SENT_BYTES, cut, sent, small

#: ASCII letters and digits, and all beyond ASCII. The rest is listed one by one, as Java looks such a class up in a table and tests ranges in turn.
WORD = "[^" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, SALT = 4, 16


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _probe(m: Column, gram: Column) -> Column:
    """A hash that equal words share whatever their ASCII case; it may be coarser than that. Sigma's lower case hangs on its neighbours, so it is set first."""
    return F.xxhash64(m, F.lower(F.replace(F.array_join(gram, " "), F.lit("Σ"), F.lit("σ"))))


def _key(window: Column) -> Column:
    return F.translate(F.array_join(window, " "), UPPER, LOWER)


def windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """benchmark(item_id, text) -> key, m, item_id: the distinct windows of each item."""
    b = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("m", F.least(F.size("w"), F.lit(size)))
    b = b.select("item_id", "m", "w", F.explode(F.expr("sequence(0, size(w) - m)")).alias("i"))
    return b.select(_key(F.slice("w", F.col("i") + 1, F.col("m"))).alias("key"), "m", "item_id").distinct()


def _key_of(doc_id: Column, text: Column) -> Column:
    """The same for rows of one doc_id and text."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("s"), doc_id.cast("string")), F.lit("n")), F.lit(":"), text))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> k, doc_id, text, w."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select(_key_of(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text", _words(F.col("text")).alias("w"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, most_bytes: int = SENT_BYTES) -> DataFrame:
    """docs(doc_id, text) -> k, doc_id, start, m, item_id: each occurrence of a window in a document. Grams of over most_bytes are met by shuffle."""
    keys = cut(windows(benchmark, size))
    lengths = sorted(r.m for r in keys.select("m").distinct().collect())  # at most `size` values
    wide = {m: m - min(GRAM, m) + 1 for m in lengths}  # places between probes
    own_grams = F.expr(f"transform(sequence(0, m - least({GRAM}, m)), i -> slice(w, i + 1, least({GRAM}, m)))")
    grams = cut(keys.withColumn("w", F.split("key", " ")).select("m", F.explode(own_grams).alias("gram")).select(_probe(F.col("m"), F.col("gram")).alias("probe")).distinct())
    none = "cast(array() AS array<struct<m: int, i: int, gram: array<string>>>)"
    # a text of fewer words has no places; a filter before would be pushed to the scan and take the words twice
    at = [f"CASE WHEN size(w) >= {m} THEN transform(sequence(0, size(w) - {m - s + 1}, {s}), i -> struct({m} AS m, i AS i, slice(w, i + 1, {m - s + 1}) AS gram)) ELSE {none} END" for m, s in wide.items()]
    d = _keyed(docs).select("k", "doc_id", "w")
    probes = d.withColumn("p", F.explode(F.expr(f"flatten(array({', '.join(at)}))" if at else none))).withColumn("probe", _probe(F.col("p.m"), F.col("p.gram")))
    if small(grams, most_bytes):
        met = probes.join(F.broadcast(grams), "probe").select("k", "doc_id", "w", "p.m", "p.i")
    else:
        salted = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        held = probes.select("k", "p.m", "p.i", "probe", F.pmod(F.xxhash64("k", "p.i"), F.lit(SALT)).cast("int").alias("salt")).join(salted, ["probe", "salt"])
        held = cut(held.groupBy("k").agg(F.collect_set(F.struct("m", "i")).alias("places")))
        met = d.join(sent(held, most_bytes), "k").select("k", "doc_id", "w", F.explode("places").alias("p")).select("k", "doc_id", "w", "p.m", "p.i")
    stride = f"(m - least({GRAM}, m) + 1)"
    near = met.select("k", "doc_id", "m", F.expr(f"greatest(i - ({stride} - 1), 0)").alias("lo"), "i", "w").select("k", "doc_id", "m", "lo", F.expr("least(i, size(w) - m)").alias("hi"), F.expr(f"slice(w, lo + 1, m + {stride} - 1)").alias("near")).where("hi >= lo")
    win = near.select("k", "doc_id", "m", F.explode(F.expr("transform(sequence(lo, hi), s -> struct(s AS start, slice(near, s - lo + 1, m) AS win))")).alias("x"))
    win = win.select("k", "doc_id", "m", F.col("x.start").alias("start"), _key(F.col("x.win")).alias("key")).withColumn("kh", F.xxhash64("key"))
    own = cut(keys.select("key", "item_id", F.xxhash64("key").alias("kh")))
    return win.join(sent(own, most_bytes), ["kh", "key"]).select("k", "doc_id", "start", "m", "item_id")


def judge(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, most_bytes: int = SENT_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit is 1 / share of the words at least)."""
    return _judged(docs, benchmark, size, share, most_bytes).drop("k")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int, share: int, most_bytes: int) -> DataFrame:
    hits = cut(contamination(docs, benchmark, size, most_bytes))
    places = hits.select("k", F.explode(F.expr("sequence(start, start + m - 1)")).alias("pos")).distinct().groupBy("k").agg(F.count("*").alias("n_hit"))
    items = hits.groupBy("k").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    found = cut(places.join(items, "k"))
    base = _keyed(docs).select("k", "doc_id", F.size("w").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return base.join(sent(found), "k", "left").select(
        "k", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("ids"), ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text: without the words that a window hits, and what follows each up to the next word."""
    hits = cut(contamination(docs, benchmark, size))
    gone = cut(hits.select("k", F.explode(F.expr("sequence(start, start + m - 1)")).alias("pos")).groupBy("k").agg(F.collect_set("pos").alias("gone")))
    d = _keyed(docs).join(sent(gone), "k", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), F.col("gone"))
    between = F.split("text", WORD, -1)
    words = F.transform(F.arrays_zip(F.col("w"), F.slice(between, F.lit(2), F.size("w")).alias("b")), lambda x: F.concat(x["w"], x["b"]))
    left = F.concat(F.get(between, F.lit(0)), F.array_join(F.get(F.transform(F.array(words), lambda z: F.transform(kept, lambda i: F.get(z, i))), 0), ""))
    return d.select("doc_id", F.when(F.col("gone").isNotNull(), left).otherwise(F.col("text")).alias("text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """docs, all columns, without the rows that judge() calls contaminated."""
    hit = cut(_judged(docs.select("doc_id", "text"), benchmark, size, share, SENT_BYTES).where("contaminated").select("k").distinct())
    rows = docs.select(F.struct("*").alias("_row"), _key_of(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("k"))
    return rows.join(sent(hit), "k", "left_anti").select("_row.*")
