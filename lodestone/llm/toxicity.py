"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

fit(): a token is a word or a prefix of it (inflections of one stem share prefixes).
Token document counts of labelled rows, by label, give log-odds under an informative
Dirichlet prior (the pooled counts) with their z-scores; near copies, told by a shared
MinHash, weigh as one document. Tokens that speak for the label beyond a z-score score
their log-odds, all others a fixed negative drift. A linear scan finds all maximal scoring segments of a text; their
Karlin-Altschul significance (P = 1 - exp(-K n e^(-lambda S))) decides which are
passages. A logistic curve over the strongest and the summed significance, fitted
on the same labelled rows, gives a score between 0 and 1.

The classifier is fitted on at most MAX_LABELLED labelled documents, whose texts are
fetched once; that bounds the model and what of it goes to the tasks. Scoring reads all
tokens of all texts.

Defined cases: a null or empty text has no passage and gets the score of no evidence;
repeated rows are scored alike, and in fitting a doc_id
counts once, with its first text; null labels are left out; with no labelled rows of
both kinds every score is 0; an empty table gives an empty result; columns other than
doc_id and text don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import cut
from ._text import FOLD, PLAIN, gram_hashes, owner, pieces, spans, word_hashes

MAX_LABELLED, FIT_TASKS = 20_000, 32
DRIFT, MIN_Z, MIN_DOCS, MIN_ODDS = -0.5, 3.0, 3.0, 2.5
#: bytes of the prefixes that are tokens, beside the whole word
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    k: float = 0.1
    weights: np.ndarray | None = None
    centre: float = 0.0


def tokens(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """(positions of words, hashes) of the whole words, then of each kind of prefix."""
    yield np.arange(len(s)), word_hashes(data, s, e)
    for n in PREFIXES:
        at = np.flatnonzero(e - s > n)
        yield at, word_hashes(data, s[at], s[at] + n) ^ np.uint64(n)


def hits(batch: pa.RecordBatch, model: Model):
    """(rows, first word of each text, positions of scoring words, their scores) for each piece."""
    for rows, data, off in pieces(batch):
        data = FOLD[data]
        s, e, words = spans(data, off, PLAIN)
        if len(model.hashes) and len(s):
            best = np.zeros(len(s))
            for at, h in tokens(data, s, e):
                i = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
                hit = model.hashes[i] == h
                at = at[hit]
                best[at] = np.maximum(best[at], model.scores[i[hit]])
            at = np.flatnonzero(best)
            yield rows, words, at, best[at]
        else:
            yield rows, words, np.zeros(0, np.int64), np.zeros(0)


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence that scores `drift` outside `at` (Ruzzo and Tompa).

    Each open segment points to the nearest one before it with a smaller sum, so that no segment is passed twice: linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, place of the nearest one with a smaller sum before
    total, last = 0.0, -1
    for p, x in zip(at.tolist(), score.tolist(), strict=True):
        total += drift * (p - last - 1)
        start, last, before = p, p, total
        total += x
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, _, before, _, up = found[j]
            del found[j:]
            j = up
        found.append((start, p + 1, before, total, j))
    return [(a, b, d - c) for a, b, c, d, _ in found]


def passages(batch: pa.RecordBatch, model: Model):
    """(rows, features) for each piece: the row's words and its (start, end, bits) passages; bits are -log2 P."""
    for rows, words, at, score in hits(batch, model):
        cuts = np.searchsorted(at, words)
        out = []
        for i in range(len(rows)):
            n, a = int(words[i + 1] - words[i]), slice(cuts[i], cuts[i + 1])
            found = segments(at[a] - words[i], score[a]) if cuts[i] < cuts[i + 1] else []
            out.append((n, [(s, e, _bits(x, n, model)) for s, e, x in found]))
        yield rows, out


def _bits(x: float, n: int, model: Model) -> float:
    expected = model.k * max(1, n) * np.exp(-model.lam * x)
    return float(-np.log2(max(-np.expm1(-expected), 1e-300)))


def _features(found: list[tuple[int, int, float]], n: int) -> list[float]:
    bits = [b for _, _, b in found]
    return [1.0, min(60.0, max(bits, default=0.0)), min(200.0, sum(bits)), np.log1p(len(bits)), np.log1p(n)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """docs(doc_id, text), labels(doc_id, <label>): learns from at most MAX_LABELLED rows of labels, the first by md5(doc_id)."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = cut(rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(MAX_LABELLED))
    known = {r.doc_id: int(r.y) for r in chosen.collect()}
    if len(set(known.values())) < 2:
        return Model()
    ids = np.array(sorted(known), np.int64)
    ys = np.array([known[i] for i in ids.tolist()], np.int64)
    few = spark.sparkContext.broadcast((ids, ys))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    some = cut(some.repartition(FIT_TASKS, "doc_id"))  # at most MAX_LABELLED rows

    def signatures(batches):
        for batch in batches:
            batch, _ = labelled(batch)
            for rows, data, off in pieces(batch):
                s, e, words = spans(FOLD[data], off, PLAIN)
                g = gram_hashes(word_hashes(FOLD[data], s, e), 2)
                a, b = words[:-1], np.maximum(words[1:] - 1, words[:-1])
                sig = np.array([int(g[i:j].min()) if j > i else 0 for i, j in zip(a, b, strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(sig.view(np.int64)), pa.array(np.diff(words))], ["doc_id", "sig", "words"])

    def labelled(batch: pa.RecordBatch):
        ids, ys = few.value
        doc = np.asarray(batch.column("doc_id").fill_null(-(1 << 62)), np.int64)
        i = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
        keep = ids[i] == doc
        return batch.filter(pa.array(keep)), ys[i[keep]]

    met = some.mapInArrow(signatures, "doc_id long, sig long, words long").toPandas()  # at most MAX_LABELLED rows
    alike = met.groupby("sig")["sig"].transform("size").where(met["sig"] != 0, 1)
    weight_of = dict(zip(met["doc_id"].tolist(), (1.0 / alike).tolist(), strict=True))
    weights = np.array([weight_of.get(i, 0.0) for i in ids.tolist()])
    clean_words = sum(n for i, n in zip(met["doc_id"].tolist(), met["words"].tolist(), strict=True) if not known.get(i))
    heavy = spark.sparkContext.broadcast(weights)

    def count(batches):
        parts = []
        for batch in batches:
            batch, y = labelled(batch)
            x = heavy.value[np.searchsorted(few.value[0], np.asarray(batch.column("doc_id"), np.int64))]
            at = 0
            for rows, data, off in pieces(batch):
                data = FOLD[data]
                s, e, words = spans(data, off, PLAIN)
                told = list(tokens(data, s, e))
                h, d = np.concatenate([h for _, h in told]), owner(words, np.concatenate([i for i, _ in told]))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                d = d[first] + at
                parts.append((h[first], y[d] * x[d], x[d]))
                at += len(rows)
        if parts:
            h, y, x = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, i = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(i, y, len(u))), pa.array(np.bincount(i, x, len(u)))], ["h", "pos", "n"])

    n1, n0 = float(weights[ys > 0].sum()), float(weights[ys == 0].sum())
    counts = some.mapInArrow(count, "h long, pos double, n double").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # a token's prior is its pooled rate, worth ten documents; the z-score is that of the difference of log-odds
    prior = 10.0
    a = F.col("n") / F.lit(n0 + n1) * F.lit(prior) + F.lit(0.5)
    p, q = F.col("pos") + a, F.col("n") - F.col("pos") + a
    odds = F.log(p / (F.lit(n1 + prior) - p + 1e-9)) - F.log(q / (F.lit(n0 + prior) - q + 1e-9))
    strong = counts.where(f"pos >= {MIN_DOCS}").withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / p + 1 / q)).where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
    terms = strong.select("h", "odds", "n", "pos").collect()  # tokens of at most MAX_LABELLED texts
    if not terms:
        return Model()
    h = np.array([t.h for t in terms], np.int64).view(np.uint64)
    order = np.argsort(h)
    model = Model(h[order], np.minimum(np.array([t.odds for t in terms])[order], 6.0))
    rate = np.array([max(0.25, t.n - t.pos) for t in terms])[order] / max(1, clean_words)  # of scoring tokens in clean text
    model.lam, model.k = _karlin(model.scores, rate)

    def features(batches):
        for batch in batches:
            batch, y = labelled(batch)
            at = 0
            for rows, found in passages(batch, model):
                x = np.array([_features(f, n) for n, f in found]).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(y[at : at + len(rows)]), *[pa.array(c) for c in x.T]], ["y", *"abcde"])
                at += len(rows)

    told = some.mapInArrow(features, "y long, a double, b double, c double, d double, e double").toPandas()  # at most MAX_LABELLED rows
    x, y = told[list("abcde")].to_numpy(), told["y"].to_numpy(float)
    model.weights = _logistic(x, y)
    return model


def _karlin(scores: np.ndarray, rate: np.ndarray, drift: float = DRIFT) -> tuple[float, float]:
    """lambda, the positive root of sum p e^(lambda s) = 1, and a K that puts one chance segment of a single mean hit at its rate."""
    rest = max(1e-9, 1 - rate.sum())
    f = lambda x: float((rate * np.exp(x * scores)).sum() + rest * np.exp(x * drift) - 1)
    lo, hi = 1e-3, 1e-3
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    lam = max(0.05, lo)
    k = float((rate * np.exp(lam * scores)).sum() * (1 - np.exp(lam * drift)))
    return lam, max(k, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, n_passages, toxic_words, spans: the (start, end) words of each passage."""

    def run(batches):
        for batch in batches:
            for rows, found in passages(batch, model):
                x = np.array([_features(f, n) for n, f in found]).reshape(-1, 5)
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))) if model.weights is not None else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(p, pa.float64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array([sum(e - s for s, e, _ in f) for _, f in found], pa.int64()), pa.array([[{"start": s, "end": e} for s, e, _ in f] for _, f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "score", "n_passages", "toxic_words", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_passages long, toxic_words long, spans array<struct<start: long, end: long>>")


def held_out(doc_id, modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on the labelled rows that aren't held out, score all: doc_id, held_out, score, predicted and the passages."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score stays below threshold; filtered where they are read, without a shuffle."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    packed = docs.select(F.struct("*").alias("row"))

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            for rows, found in passages(pa.RecordBatch.from_arrays([row, pc.struct_field(row, "text")], ["row", "text"]), model):
                x = np.array([_features(f, n) for n, f in found]).reshape(-1, 5)
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))) if model.weights is not None else np.zeros(len(x))
                yield rows.select(["row"]).filter(pa.array(p < threshold))

    return packed.mapInArrow(run, packed.schema).select("row.*")
