"""Vocabulary mining and query compilation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, collapse, ngrams
from ..plans.lineage import cut, sent, small

#: words that are counted at once, beyond which a task goes on with the next documents
PIECE = 1 << 20


def _counts(rows: pa.RecordBatch, lens: np.ndarray, sizes: tuple[int, ...], among: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """rows(by, words) with lens words each -> by, term, tf, df, most: of each run of so many words, those that are all `among` the given."""
    words = rows.column(1).flatten().dictionary_encode()
    told, word, doc = words.dictionary, words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lens)), lens)
    by = rows.column(0).dictionary_encode(null_encoding="encode")
    ok = np.ones(len(word), bool) if among is None else pc.is_in(told, value_set=among).to_numpy(zero_copy_only=False)[word]
    code, live = word, ok
    for k in range(1, max(sizes) + 1):
        if k > 1:
            # what starts at a place is the run of k - 1 from there and the word behind it
            live = live[:-1] & ok[k - 1 :] & (doc[k - 1 :] == doc[: 1 - k])
            runs, own = np.unique(code[:-1][live] * len(told) + word[k - 1 :][live], return_inverse=True)
            code = np.zeros(len(live), np.int64)
            code[live] = own
        at = np.flatnonzero(live)
        if not len(at):
            return
        if k not in sizes:
            continue
        run, count = code[at], int(code[at].max()) + 1
        pair, n = np.unique(doc[at] * count + run, return_counts=True)
        key = by.indices.to_numpy()[pair // count].astype(np.int64) * count + pair % count
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        place = np.zeros(count, np.int64)
        place[run] = at
        start = place[key[heads] % count]
        parts = [told.take(pa.array(word[start + i])) for i in range(k)]
        term = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        found = [by.dictionary.take(pa.array(key[heads] // count)), term, pa.array(np.add.reduceat(n, heads)), pa.array(np.diff(np.append(heads, len(n)))), pa.array(np.maximum.reduceat(n, heads))]
        yield pa.RecordBatch.from_arrays(found, ["by", "term", "tf", "df", "most"])


def _pieces(batches: Iterable[pa.RecordBatch], sizes: tuple[int, ...], among: list[str] | None) -> Iterator[pa.RecordBatch]:
    chosen = None if among is None else pa.array(among, pa.string())
    for batch in batches:
        lens = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lens), 0
        while at < len(lens):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield from _counts(batch.slice(at, stop - at), lens[at:stop], sizes, chosen)
            at = stop


def term_counts(docs: DataFrame, tokens: Column, by: Column | None = None, sizes: tuple[int, ...] = (1,), among: list[str] | None = None) -> DataFrame:
    """One row a document -> by (a text), term, tf, df, most: how often a run of words stands in all documents, in how many of them, and how often in one at most.

    Runs have so many words as `sizes` says, joined by a space, and with `among` only its words. They are counted by arrays
    where documents are read, so that what moves is a row for each term of some million words.
    """
    told = docs.select((F.lit(None) if by is None else by).cast("string").alias("by"), F.array_compact(tokens).alias("words"))
    found = told.mapInArrow(partial(_pieces, sizes=sizes, among=among), "by string, term string, tf long, df long, most long")
    return found.groupBy("by", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.max("most").alias("most"))


def _by_id(docs: DataFrame, tokens: Column, most: int) -> DataFrame:
    """docs(id, text) -> term, tf, df, most, where rows of one id are one document."""
    own = docs.select("id", tokens.alias("_w")).select("id", F.explode(ngrams(F.col("_w"), most)).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return own.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), F.max("tf").alias("most"))


def mine_terms(docs: DataFrame, known: DataFrame | None, tokens: Column, most: int = 3, least_df: int = 2, limit: int = 500) -> DataFrame:
    """docs(id, text) -> the `limit` best terms not in known(term): tf (1 + spaces / 4) ln(1 + N / df).

    Words are counted first. A longer term stands at most as often as each of its words, in all and in one document, so
    it is in at least tf / most documents: what a word's terms can reach is bounded by its own counts. Longer terms
    are counted only of words that can reach the `limit`-th best word, which loses none of the best.
    """
    n = F.lit(float(docs.count()))
    spaces = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
    again = cut(docs.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("_id")))
    one, several = docs, None
    if not again.isEmpty():
        one, several = (docs.join(sent(again), F.col("id").eqNullSafe(F.col("_id")), how) for how in ("left_anti", "left_semi"))

    def counted(sizes, among=None):
        c = term_counts(one, tokens, None, sizes, among).drop("by")
        if several is None:
            return c
        c = c.unionByName(_by_id(several, tokens, max(sizes)).where(F.lit(1 in sizes) | (spaces > 0)))
        return c.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.max("most").alias("most"))

    def best(t):
        t = t.where(F.col("df") >= least_df)
        t = t if known is None else t.join(known.select("term").distinct(), "term", "left_anti")
        t = t.select("term", "tf", "df", (F.col("tf") * (1 + 0.25 * spaces) * F.log1p(n / F.col("df"))).alias("score"))
        return t.orderBy(F.col("score").desc(), F.col("df").desc(), "term").limit(limit)

    words = cut(counted((1,)))
    if not words.where(spaces > 0).isEmpty():  # a word with a space may be a term in two ways
        return best(_by_id(docs, tokens, most))
    if most == 1:
        return best(words)
    top = best(words).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = top.least * (1 - 1e-9) if top.n == limit and limit else 0.0
    reach = F.col("tf") * (1 + 0.25 * (most - 1)) * F.log1p(n / F.greatest(F.col("tf") / F.col("most"), F.lit(float(max(least_df, 1)))))
    able = words.where((reach >= least) & (F.col("tf") >= least_df)).select("term")
    among = [r.term for r in able.collect()] if small(able) else None
    return best(words.unionByName(counted(tuple(range(2, most + 1)), among)))


def compile_clauses(terms: DataFrame, group: str, n: int = 24) -> DataFrame:
    """terms(group, text, weight, ord): of equal folded texts the heaviest, then the n best of each group."""
    folded = casefold(collapse(F.col("text")))
    best = terms.withColumn("folded", folded).withColumn("_r", F.row_number().over(Window.partitionBy(group, "folded").orderBy(F.col("weight").desc(), "ord"))).where("_r = 1")
    w = Window.partitionBy(group).orderBy(F.col("weight").desc(), "folded")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_r")
