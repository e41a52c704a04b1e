"""Rolling windows over sources: minute panes with length histograms, merged cumulatively to ranks.

Rows are summed by source, minute and length before they are shuffled, then to panes: one
row a source and minute with its count, sum, set of languages and sorted histogram of
lengths. A source's panes are dealt into blocks of `block` minutes, each with the panes
that its windows reach back to (a pane goes to two blocks where `block` is the longest
window), so a source of any size spreads over its blocks. In a block each window slides
from pane to pane: histograms that come in are added to the merged one, those that leave
are taken off, and ranks are read from cumulated counts, at first of 256 lengths at once.
What a task holds are the panes of one source in two blocks of time: distinct lengths of
each minute, not rows. Features go back to rows by source and minute; minutes of very many
rows are dealt to several tasks.

Times are whole minutes. A window of W seconds before t holds what lies in [t - W, t).
Defined cases: null keys are one source; null lengths count as rows without length, empty
texts have length 0; ties in length are told apart by nothing and need not be; rows that
repeat an id are rows of their own; a row without time has empty windows and lies in
none; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cut import cut, spread

MINUTE = 60
WINDOWS = (600, 43200)
#: ranks are read from sums of so many lengths first
COARSE = 256


def event_minute(doc_id: Column) -> Column:
    """floor((doc_id + crc32 mod 10000) / 6), in whole numbers throughout."""
    x = doc_id + F.crc32(doc_id.cast("string")) % 10000
    return F.call_function("div", x - F.pmod(x, F.lit(6)), F.lit(6))


def panes(rows: DataFrame) -> DataFrame:
    """rows(key, minute, length, label) -> key, minute, n, total, labels, lengths, counts."""
    by_length = rows.where("minute IS NOT NULL").groupBy("key", "minute", "length").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"))
    hist = F.sort_array(F.collect_list(F.when(F.col("length").isNotNull(), F.struct("length", "n"))))
    told = by_length.groupBy("key", "minute").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0).cast("long")).alias("total"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), hist.alias("hist"))
    return told.select("key", "minute", "n", "total", "labels", F.col("hist.length").alias("lengths"), F.col("hist.n").alias("counts"))


class _Merged:
    """The merged histogram of a window, over all lengths of a block."""

    def __init__(self, n: int):
        self.fine, self.coarse = np.zeros(-(-n // COARSE) * COARSE + COARSE, np.int64), np.zeros(-(-n // COARSE) + 1, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.fine, codes, counts)
        np.add.at(self.coarse, codes // COARSE, counts)

    def ranks(self, asked: np.ndarray) -> list[int]:
        """Codes of the asked[i]-th smallest lengths, counted from 1."""
        ends, out = np.cumsum(self.coarse), []
        for k, b in zip(asked.tolist(), np.searchsorted(ends, asked).tolist(), strict=True):
            k -= int(ends[b - 1]) if b else 0
            out.append(b * COARSE + int(np.searchsorted(np.cumsum(self.fine[b * COARSE : (b + 1) * COARSE]), k)))
        return out


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a column of lists."""
    a = column.combine_chunks()
    return np.concatenate(([0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64), a.flatten()


def slide(t: pa.Table, first: int, last: int, windows: tuple[int, ...]) -> Iterator[dict]:
    """Features of each pane of `t` in [first, last), from all panes before it."""
    t = t.sort_by("minute")
    minute, n, total = (t.column(c).to_numpy() for c in ("minute", "n", "total"))
    at, lengths = _flat(t.column("lengths"))
    counts = _flat(t.column("counts"))[1].to_numpy().astype(np.int64)
    kinds, codes = np.unique(lengths.to_numpy(), return_inverse=True)
    label_at, labels = _flat(t.column("labels"))
    label = labels.dictionary_encode().indices.to_numpy() if len(labels) else np.zeros(0, np.int64)
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (n, total)]
    with_length = np.concatenate(([0], np.cumsum(counts)))[at]
    targets = np.flatnonzero((minute >= first) & (minute < last))
    found: dict[int, list] = {int(i): [] for i in targets}
    for w in windows:
        lows = np.searchsorted(minute, minute[targets] - w // MINUTE)
        merged, seen = _Merged(len(kinds)), np.zeros(int(label.max(initial=-1)) + 1, np.int64)
        a = b = int(lows[0]) if len(lows) else 0
        for i, low in zip(targets.tolist(), lows.tolist(), strict=True):
            merged.add(codes[at[b] : at[i]], counts[at[b] : at[i]])
            merged.add(codes[at[a] : at[low]], -counts[at[a] : at[low]])
            np.add.at(seen, label[label_at[b] : label_at[i]], 1)
            np.add.at(seen, label[label_at[a] : label_at[low]], -1)
            a, b = low, i
            m = int(with_length[i] - with_length[low])
            ranks = [kinds[c] for c in merged.ranks(np.array([-(-m // 2), -(-90 * m // 100)]))] if m else [None, None]
            found[i].append((int(sums[0][i] - sums[0][low]), int(sums[1][i] - sums[1][low]), int(np.count_nonzero(seen)), *ranks))
    for i, f in found.items():
        yield {"minute": int(minute[i]), "n": int(n[i]), **dict(zip(("n_events", "sum_chars", "n_langs", "median_chars", "high_chars"), map(list, zip(*f, strict=True)), strict=True))}


def features(rows: DataFrame, windows: tuple[int, ...] = WINDOWS, block: int | None = None) -> DataFrame:
    """rows(key, minute, length, label) -> one row for each key and minute that has rows: n, and each feature as a list with an entry a window."""
    back = max(windows) // MINUTE
    size = block or back
    of = lambda m: F.call_function("div", m - F.pmod(m, F.lit(size)), F.lit(size))
    dealt = panes(rows).withColumn("block", F.explode(F.sequence(of(F.col("minute")), of(F.col("minute") + back))))
    schema = pa.schema([("key", pa.string()), ("minute", pa.int64()), ("n", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("n_events", "sum_chars", "n_langs", "median_chars", "high_chars")])

    def run(key, table):
        first = key[1].as_py() * size
        return pa.Table.from_pylist([{"key": key[0].as_py(), **r} for r in slide(table, first, first + size, windows)], schema=schema)

    return dealt.groupBy("key", "block").applyInArrow(run, "key string, minute long, n long, n_events array<long>, sum_chars array<long>, n_langs array<long>, median_chars array<long>, high_chars array<long>")


def rolling(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, block: int | None = None) -> DataFrame:
    """docs(doc_id, source, lang, text) -> a row for each row and window: doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(key, event_minute(doc_id).alias("minute"), F.length("text").cast("long").alias("length"), F.col("lang").alias("label"))
    found = cut(features(rows, windows, block))
    back = spread(docs.select(doc_id.alias("doc_id"), key, event_minute(doc_id).alias("minute")), found, ["key", "minute"], "n", "doc_id", send=False)
    each = back.select("*", F.posexplode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("i", "window_s"))
    zero = [F.coalesce(F.get(c, F.col("i")), F.lit(0).cast("long")).alias(c) for c in ("n_events", "sum_chars", "n_langs")]
    return each.select("doc_id", "window_s", (F.col("minute") * MINUTE).alias("event_s"), *zero, *[F.get(c, F.col("i")).alias(c) for c in ("median_chars", "high_chars")])
