"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

1. All words of all training documents are counted (a shuffle that grows with the input).
   Words are discounted by D = n1 / (n1 + 2 n2), of n1 words met once and n2 met twice; the
   freed share D V / N is the probability of an unknown word.
2. The WORDS most frequent words, and one class for the rest, are the vocabulary of the
   log-bilinear model (see _lbl): three words of context, each with a matrix of its
   own, and a vector for each word to be told. Texts are dealt to rounds, one more for each
   fourfold of the corpus. In a round every task makes a pass over its share, of about
   TASK_TOKENS tokens, from the mean of the round before; what tasks moved is averaged row
   by row, each weighed by how often it moved the row, in groups of tasks first.
3. All texts are scored in batches: matrix products give each token's probability,
   normalised over the vocabulary; a rest word adds its discounted share of the rest.

Words are looked up in a table of at most WIDE frequent words, which goes to every task;
all other words, however many, are met with their counts by a join.

Defined cases: a null or empty text has one token, its end; null doc_ids count for
training; repeated rows are scored and counted once each; an unknown word has the
probability of the unknown as a whole; with no training document every word is
unknown, which is then certain; an empty table gives an empty result; other columns don't
matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _lbl
from ._cut import cut
from ._text import FOLD, SPACED, pieces, spans, word_hashes

WORDS, WIDE, TASK_TOKENS, PASSES, CHUNK = (1 << 16) - 1, 1 << 19, 1 << 22, 1, 1024
END = np.uint64(0xE0D)


@dataclass
class Counts:
    total: int
    distinct: int
    once: int
    twice: int
    wide: np.ndarray  # hashes of the wide table, sorted
    counts: np.ndarray
    ranks: np.ndarray  # of the wide words in the vocabulary, 0 for the rest

    @property
    def discount(self) -> float:
        return min(0.9, self.once / max(1, self.once + 2 * self.twice))

    @property
    def unknown(self) -> float:
        """The probability of an unknown word."""
        if not self.total:
            return 1.0
        return max(self.discount * self.distinct / self.total, 1 / (self.total + self.distinct + 1))

    @property
    def rest(self) -> float:
        """Discounted counts of all words outside the vocabulary."""
        top = self.ranks > 0
        return max(0.0, self.total - float(self.counts[top].sum()) - self.discount * (self.distinct - int(top.sum())))

    def tree(self) -> _lbl.Tree:
        top = np.flatnonzero(self.ranks)
        weights = np.zeros(len(top) + 1)
        weights[0] = self.rest
        weights[self.ranks[top]] = self.counts[top] - self.discount
        return _lbl.Tree.of(weights)


@dataclass
class Fitted:
    table: DataFrame  # h, c: all training words
    counts: Counts
    tree: _lbl.Tree
    model: _lbl.Model


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END after each text, and where texts begin among them."""
    data = FOLD[data]
    s, e, words = spans(data, off, SPACED)
    n = np.diff(words) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1], END, np.uint64)
    body = np.ones(len(out), bool)
    body[first[1:] - 1] = False
    out[body] = word_hashes(data, s, e)
    return out, first


def find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the sorted table, -1 where there is none."""
    if not len(table):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, i, -1)


def _count(batches):
    held, size = [], 0

    def merged():
        u, i = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return u, np.bincount(i, np.concatenate([n for _, n in held]), len(u)).astype(np.int64)

    for batch in batches:
        for _, data, off in pieces(batch):
            held.append(np.unique(tokens(data, off)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                u, n = merged()
                held, size = [(u, n)], 0
                if len(u) > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])
                    held = []
    if held:
        u, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])


def gather(train: DataFrame, words: int = WORDS, wide: int = WIDE) -> tuple[DataFrame, Counts]:
    """Word counts of all training texts: the table (h, c), and what the driver holds of it, of bounded size."""
    table = cut(train.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    total, distinct, once, twice = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    levels, room, least = table.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc()).limit(wide), wide, 1 << 62
    for c, n in ((r.c, r.n) for r in levels.collect()):  # at most `wide` rows: one for each distinct count
        if n > room:
            break
        room, least = room - n, c
    found = table.where(F.col("c") >= least).toArrow()
    h, c = np.asarray(found["h"], np.int64).view(np.uint64), np.asarray(found["c"], np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    ranks = np.zeros(len(h), np.int32)
    top = np.lexsort((h, -c))[:words]
    ranks[top] = np.arange(1, len(top) + 1)
    return table, Counts(int(total), int(distinct), int(once), int(twice), h, c, ranks)


def lookup(counts: Counts, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the wide table, -1 for none, and ranks in the vocabulary, 0 for the rest."""
    i = find(counts.wide, h)
    return i, np.where(i >= 0, counts.ranks[np.maximum(i, 0)] if len(counts.ranks) else 0, 0).astype(np.int32)


def train_round(train: DataFrame, counts: Counts, tree: _lbl.Tree, model: _lbl.Model, seed: int, total: int, tokens_each: int = TASK_TOKENS) -> _lbl.Model:
    """One pass over these training texts, of about `total` tokens, in tasks that each start from model; the average of what they moved."""
    sent = train.sparkSession.sparkContext.broadcast((counts, tree, model))

    def run(batches):
        counts, tree, model = sent.value
        own = _lbl.Trainer(tree, model, seed=seed * 1_000_003 + TaskContext.get().partitionId())
        ids, lengths = [], []

        def flush():
            own.texts(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))
            ids.clear()
            lengths.clear()

        for batch in batches:
            for _, data, off in pieces(batch):
                h, first = tokens(data, off)
                ids.append(lookup(counts, h)[1])
                lengths.append(np.diff(first))
                if sum(map(len, ids)) >= 16 * _lbl.BATCH:
                    flush()
        if ids:
            flush()
        for k, (old, new, seen) in enumerate(zip(model.arrays(), own.model.arrays(), own.seen, strict=True)):
            for i in range(0, len(old), CHUNK):
                z = slice(i, i + CHUNK)
                if seen[z].any():
                    moved = (new[z] - old[z]) * seen[z][:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i]), pa.array([TaskContext.get().partitionId() % groups]), pa.array([moved.tobytes()]), pa.array([seen[z].tobytes()])], ["k", "i", "g", "moved", "seen"])

    def summed(batches):
        key, moved, seen = None, None, None
        for batch in batches:
            for k, i, m, n in zip(*(batch.column(c).to_pylist() for c in ("k", "i", "moved", "seen")), strict=True):
                m, n = np.frombuffer(m, np.float32).astype(np.float64), np.frombuffer(n, np.float32).astype(np.float64)
                if key == (k, i):
                    moved, seen = moved + m, seen + n
                    continue
                if key is not None:
                    yield done(key, moved, seen)
                key, moved, seen = (k, i), m, n
        if key is not None:
            yield done(key, moved, seen)

    def done(key, moved, seen):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([moved.astype(np.float32).tobytes()]), pa.array([seen.astype(np.float32).tobytes()])], ["k", "i", "moved", "seen"])

    tasks = max(1, -(-total // tokens_each))
    groups = max(1, round(tasks**0.5))  # what tasks moved is summed by group of tasks, then over groups, so that no task has all of a chunk
    moved = train.select("text").coalesce(tasks).mapInArrow(run, "k long, i long, g long, moved binary, seen binary")
    for keys in (["k", "i", "g"], ["k", "i"]):
        moved = moved.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed, "k long, i long, moved binary, seen binary")
    mean = moved.toArrow()  # the size of the model
    out = _lbl.Model(model.C.copy(), model.R.copy(), [v.copy() for v in model.V])
    for k, i, m, n in zip(*(mean[c].to_pylist() for c in ("k", "i", "moved", "seen")), strict=True):
        a = out.arrays()[k]
        a[i : i + CHUNK] += np.frombuffer(m, np.float32).reshape(-1, a.shape[1]) / np.maximum(np.frombuffer(n, np.float32), 1e-9)[:, None]
    sent.unpersist()
    return out


def rounds_of(total: int, tokens_each: int = TASK_TOKENS) -> int:
    """One round, and one more for each fourfold of what a task takes."""
    return 1 + max(0, int(np.log(max(1.0, total / tokens_each)) / np.log(4)))


def fit(train: DataFrame, words: int = WORDS, wide: int = WIDE, passes: int = PASSES, tokens_each: int = TASK_TOKENS) -> Fitted:
    """train(text, and doc_id if there is one): counts and the model of all its texts."""
    table, counts = gather(train, words, wide)
    tree = counts.tree()
    model = _lbl.Model.new(tree)
    rounds = rounds_of(counts.total, tokens_each)
    # texts are dealt to rounds, each of which goes on from the mean of the one before
    own = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in train.columns]), F.lit(rounds))
    for i in range(passes * rounds if counts.total else 0):
        part = train if rounds == 1 else train.where(own == i % rounds)
        model = train_round(part, counts, tree, model, i, counts.total // rounds, tokens_each)
    return Fitted(table, counts, tree, model)


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, words: int = WORDS, wide: int = WIDE, fitted: Fitted | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; fitted: by default on the rows that aren't held out."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    fitted = fitted or fit(docs.where("NOT held_out"), words, wide)
    counts = fitted.counts
    sent = docs.sparkSession.sparkContext.broadcast((counts, fitted.tree, fitted.model))
    log_known = float(np.log10(max(1e-300, 1 - counts.unknown))) if counts.total else 0.0

    def run(batches):
        counts, tree, model = sent.value
        log_c, log_rest = np.log10(counts.counts + 1.0), np.log10(np.maximum(counts.counts - counts.discount, 1e-9) / max(counts.rest, 1e-9))
        for batch in batches:
            for rows, data, off in pieces(batch):
                h, first = tokens(data, off)
                i, ids = lookup(counts, h)
                there = i >= 0
                ctx = _lbl.contexts(ids, first, tree.words)
                lp = np.concatenate([_lbl.log_probabilities(tree, model, ids[a : a + (1 << 18)], _lbl.vectors(model, ctx[:, a : a + (1 << 18)])) for a in range(0, len(ids), 1 << 18)]) / np.log(10)
                at = i[there]
                base, own = np.zeros(len(h)), np.zeros(len(h))
                base[there] = log_c[at]
                own[there] = lp[there] + np.where(ids[there] == 0, log_rest[at], 0.0)
                sums = [np.add.reduceat(x.astype(float), first[:-1]) for x in (there, base, own)]
                # words beyond the table: how often each stands in a text, and the sum of what the model gives the rest there
                tail = np.flatnonzero(~there)
                text = np.searchsorted(first, tail, "right") - 1
                order = np.lexsort((h[tail], text))
                tail, text = tail[order], text[order]
                w, p = h[tail], lp[tail]
                new = np.ones(len(tail), bool)
                new[1:] = (w[1:] != w[:-1]) | (text[1:] != text[:-1])
                begin = np.flatnonzero(new)
                m = np.diff(np.append(begin, len(tail)))
                p = np.add.reduceat(np.maximum(p, -300), begin) if len(begin) else np.zeros(0)
                items = pa.StructArray.from_arrays([pa.array(w[begin].view(np.int64)), pa.array(m), pa.array(p)], ["h", "m", "lp"])
                lists = pa.ListArray.from_arrays(np.searchsorted(text[begin], np.arange(len(rows) + 1)).astype(np.int32), items)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), lists], ["id", "doc_id", "held_out", "n", "known", "log_c", "log_p", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.withColumn("id", F.monotonically_increasing_id()).select("id", "doc_id", "held_out", "text")
    per = cut(told.mapInArrow(run, f"id long, doc_id {kind}, held_out boolean, n long, known long, log_c double, log_p double, tail array<struct<h: long, m: long, lp: double>>"))
    rare = per.select("id", F.explode("tail").alias("x")).select("id", "x.*").join(fitted.table, "h")
    share = F.log10((F.col("c") - F.lit(counts.discount)) / F.lit(max(counts.rest, 1e-9)))
    met = rare.groupBy("id").agg(F.sum("m").alias("tail_known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("tail_log_c"), F.sum(F.col("lp") + F.col("m") * share).alias("tail_log_p"))
    d = per.drop("tail").join(met, "id", "left").na.fill(0, ["tail_known"]).na.fill(0.0, ["tail_log_c", "tail_log_p"])
    known = F.col("known") + F.col("tail_known")
    base = F.col("log_c") + F.col("tail_log_c") - F.col("n") * F.lit(float(np.log10(counts.total + counts.distinct + 1)))
    own = F.col("log_p") + F.col("tail_log_p") + known * F.lit(log_known) + (F.col("n") - known) * F.lit(float(np.log10(counts.unknown)))
    return d.select("doc_id", "held_out", F.col("n").alias("n_tokens"), known.alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"))
