"""Substring dedup: a compressed FM-index per shard, past which the other documents stream.

1. Documents with the same words are met by hash; only the first is searched, the later
   ones lose all windows.
2. Each window of `window` words has an anchor, its leftmost smallest ANCHOR-gram hash.
   Equal windows have equal anchors, so anchors that one text alone holds are dropped,
   and the others deal the text into shards: a run of windows with one anchor goes, as
   words, to the shard of that anchor. Of runs with equal words the first goes on, the
   later ones lose all their windows.
3. In a shard the first document of each anchor is indexed (k-ordered BWT in a wavelet
   tree) and the runs of the others stream past the index: backward search gives their
   matching statistics, windows of full length are reported as intervals and what is
   left goes on. Of it the next two documents are indexed, then four, and so on, until
   no anchor has a second document left. So a window is indexed once, in its first holder.
4. An anchor with runs of more than SHARD texts would fill a shard. Its windows are
   counted by their own hash, which tells what a run may hold of which first document;
   those parts alone are met, an index of the first document's runs with the runs
   that stream past it, as many to a shard as it takes.

Intervals are joined to the texts and cut out. Of a text its shared runs are shuffled, the
whole only if it loses a part.

Defined cases: a null text has no words; a document of fewer than `window` words keeps
all; windows repeated within one document only are kept; a document is known by its
doc_id and text, so rows that repeat both are answered once each, and rows that repeat the
doc_id alone are searched by themselves and lose nothing to each other; null doc_ids are
dropped; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import cut, sent, spread
from ._fm import Index
from ._text import BASE, BASE_INV, SPACED, gram_hashes, mix64, pieces, powers, spans, word_hashes

WINDOW, ANCHOR, SHARD, PART = 50, 8, 512, 1 << 19
#: windows of a run at most: longer ones are cut, and still meet in one shard
RUN = 128


def _anchor_runs(h: np.ndarray, words: np.ndarray, window: int, gram: int):
    """(text, first window, windows, anchor hash) of each run of windows of one text with one anchor."""
    g = gram_hashes(h, gram)
    wide = window - gram + 1
    n = len(g) - wide + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # the minimum of each stretch of `wide` grams
    low, h2 = g, 1
    while h2 < wide:
        step = min(h2, wide - h2)
        low = np.minimum(low[: len(low) - step], low[step:])
        h2 += step
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))[:n]
    ok = np.arange(n) + window <= words[1:][text]
    place = np.flatnonzero(ok)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(place), bool)
    # windows in a row whose anchors have one hash are one run, so a word said over and over is one run too
    new[1:] = (low[place][1:] != low[place][:-1]) | (text[place][1:] != text[place][:-1])
    begin = np.flatnonzero(new)
    new |= (np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))) % RUN == 0
    head = np.flatnonzero(new)
    first = place[head]
    return text[first], first - words[text[first]], np.diff(np.append(head, len(place))), low[first]


def _told(window: int, gram: int):
    """(doc_id, text, t) -> doc_id, t, n_words, sha256 of the words joined by one space, and the runs: anchor, first window, windows."""

    def run(batches):
        for batch in batches:
            for rows, data, off in pieces(batch):
                raw = data.tobytes()
                s, e, words = spans(data, off, SPACED)
                text, first, count, low = _anchor_runs(word_hashes(data, s, e), words, window, gram)
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                edge = np.searchsorted(text, np.arange(len(rows) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (low.view(np.int64), first.astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("t"), pa.array(np.diff(words)), pa.array(sha, pa.binary()), *lists], ["doc_id", "t", "n_words", "sha", "anchors", "starts", "ns"])

    return run


def _runs(window: int):
    """Texts with their runs -> (route, k1, k2, doc_id, t, start, n, words): one row a run; k1, k2: 128 bits of its content."""

    def run(batches):
        for batch in batches:
            for rows, data, off in pieces(batch):
                s, e, words = spans(data, off, SPACED)
                h = word_hashes(data, s, e)
                raw = data.tobytes()
                own = rows.column("runs")
                count = np.array([len(x) for x in own], np.int64)
                flat = own.flatten()
                route, start, n = (np.asarray(flat.field(c), np.int64) for c in ("anchor", "start", "n"))
                of = np.repeat(np.arange(len(rows)), count)
                x = words[:-1][of] + start
                y = x + n + window - 1
                keys = []
                for z in (h, mix64(h)):
                    total = np.zeros(len(z) + 1, np.uint64)
                    np.cumsum(z * powers(BASE, len(z)), out=total[1:])
                    keys.append(mix64((total[y] - total[x]) * powers(BASE_INV, len(z) + 1)[x] + (y - x).astype(np.uint64)))
                at = pa.array(of)
                for i in range(0, len(of), 4096):  # a text may stand in many runs
                    z = slice(i, i + 4096)
                    text = [raw[a:b] for a, b in zip(s[x[z]].tolist(), e[y[z] - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(route[z]), *[pa.array(k[z].view(np.int64)) for k in keys], *[rows.column(c).take(at[z]) for c in ("doc_id", "t")], pa.array(start[z]), pa.array(n[z]), pa.array(text, pa.binary())], ["route", "k1", "k2", "doc_id", "t", "start", "n", "words"])

    return run


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, end to end, and how many each has. Pieces bound the memory of the byte arrays."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    hashes, lengths, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
        b = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        s, e, words = spans(b, off[i : j + 1] - off[i], SPACED)
        hashes.append(word_hashes(b, s, e))
        lengths.append(np.diff(words))
        i = j
    return np.concatenate(hashes), np.concatenate(lengths)


def _slices(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places a, a + 1, ... a + n - 1 of each row, end to end."""
    return np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)


def _stretches(bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, length) of the runs of set bits within each row; n: bits of each row."""
    begin = np.cumsum(n) - n
    new = bits.copy()
    new[1:] &= ~bits[:-1]
    new[begin[n > 0]] = bits[begin[n > 0]]
    last = bits.copy()
    last[:-1] &= ~bits[1:]
    end = begin + n - 1
    last[end[n > 0]] = bits[end[n > 0]]
    first, stop = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(np.cumsum(n), first, "right")
    return row, first - begin[row], stop - first + 1


def repeated(group: np.ndarray, doc: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, window: int, step: int = 1 << 14):
    """Texts of one group, in order of group and doc -> (text, first window, windows) that a smaller doc of the group holds, batch by batch."""
    text, at, n = np.arange(len(doc)), np.cumsum(lengths) - lengths, lengths - window + 1
    first, quota = np.zeros(len(doc), np.int64), 1
    while True:
        g, d = group[text], doc[text]
        # a group with one document left is done; of the others the first `quota` documents are indexed
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        new = fresh.copy()
        new[1:] |= d[1:] != d[:-1]
        place = np.cumsum(new) - 1  # of its document
        base = np.maximum.accumulate(np.where(fresh, place, 0))
        place = place - base
        many = np.zeros(len(g), np.int64)
        heads = np.flatnonzero(fresh)
        if len(heads):
            many = np.repeat(np.maximum.reduceat(place, heads) + 1, np.diff(np.append(heads, len(g))))
        keep = many > 1
        text, at, n, first, place = text[keep], at[keep], n[keep], first[keep], place[keep]
        if not len(text):
            return
        lead = place < quota
        index = Index(hashes[_slices(at[lead], n[lead] + window - 1)], n[lead] + window - 1, doc[text[lead]], window)
        asked = np.flatnonzero(place > 0)
        left = [(np.zeros(0, np.int64),) * 3]
        for i in range(0, len(asked), step):
            q = asked[i : i + step]
            least = index.statistics(hashes[_slices(at[q], n[q] + window - 1)], n[q] + window - 1)
            gone = (least >= 0) & (least < np.repeat(doc[text[q]], n[q]))
            row, a, m = _stretches(gone, n[q])
            yield text[q[row]], first[q[row]] + a, m
            row, a, m = _stretches(~gone, n[q])
            row = q[row]
            on = ~lead[row]
            left.append((row[on], a[on], m[on]))
        row, a, m = (np.concatenate(x) for x in zip(*left, strict=True))
        text, at, n, first = text[row], at[row] + a, m, first[row] + a
        quota *= 2


def _search(window: int, part: int):
    """A shard's runs (route, doc_id, t, start, words) in order of anchor and doc_id -> (doc_id, t, start, end) of windows that a smaller doc_id holds."""

    def flush(held):
        group, doc, t, start = (np.concatenate([x[k] for x in held]) for k in range(4))
        hashes, lengths = _hashes([z for x in held for z in x[4]])
        for text, a, m in repeated(group, doc, hashes, lengths, window):
            begin = start[text] + a
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[text], t[text], begin, begin + m - 1 + window)], ["doc_id", "t", "start", "end"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            route, doc, t, start = (np.asarray(batch.column(c), np.int64) for c in ("route", "doc_id", "t", "start"))
            edge = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), len(route)) if len(route) else [0]
            text = batch.column("words")
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if size > part * 6 and route[a] != last:  # bytes; about six a word
                    yield from flush(held)
                    held, size = [], 0
                last = route[a]
                held.append((route[a:b], doc[a:b], t[a:b], start[a:b], text[a:b].to_pylist()))
                size += sum(map(len, held[-1][4]))
        if held:
            yield from flush(held)

    return run


def _windows(window: int):
    """Runs -> (route, k1, k2, doc_id, t, run, place): their windows, by 128 bits of content; run: the run's first window."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                rows = batch.slice(i, 2048)
                h, lengths = _hashes(rows.column("words").to_pylist())
                whole, again = gram_hashes(h, window), gram_hashes(mix64(h), window)
                n = np.maximum(0, lengths - window + 1)
                of = np.repeat(np.arange(len(rows)), n)
                where = _slices(np.cumsum(lengths) - lengths, n)
                names = ("route", "doc_id", "t", "start")
                yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(of)) for c in names], pa.array(whole[where].view(np.int64)), pa.array(again[where].view(np.int64))], ["route", "doc_id", "t", "run", "k1", "k2"])

    return run


def _stream(window: int):
    """Rows (route, first, salt, asked, doc_id, t, start, words), the runs of the first document before those that stream past them -> (doc_id, t, start, end)."""

    def flush(texts, index_doc, asked):
        if not asked:
            return
        h, lengths = _hashes(texts)
        index = Index(h, lengths, np.full(len(lengths), index_doc), window)
        h, lengths = _hashes([x[3] for x in asked])
        n = np.maximum(0, lengths - window + 1)
        row, a, m = _stretches(index.statistics(h, lengths) >= 0, n)
        doc, t, start = (np.array([x[k] for x in asked], np.int64) for k in range(3))
        begin = start[row] + a
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], t[row], begin, begin + m - 1 + window)], ["doc_id", "t", "start", "end"])

    def run(batches):
        key, texts, asked = None, [], []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("route", "first", "salt", "asked", "doc_id", "t", "start")), strict=True)
            for i, (route, first, salt, ask, doc, t, start) in enumerate(rows):
                if key != (route, first, salt):
                    yield from flush(texts, key and key[1], asked)
                    key, texts, asked = (route, first, salt), [], []
                words = batch.column("words")[i].as_py()
                if ask:
                    asked.append((doc, t, start, words))
                else:
                    texts.append(words)
        yield from flush(texts, key and key[1], asked)

    return run


def _crowded(lead: DataFrame, window: int, shard: int) -> DataFrame:
    """Runs of anchors that many unlike runs share -> doc_id, t, start, end."""
    lead = cut(lead)
    single = cut(lead.select("route", "doc_id", "t", "start", "words").mapInArrow(_windows(window), "route long, doc_id long, t long, run long, k1 long, k2 long"))
    least = cut(single.groupBy("route", "k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"))
    claim = cut(spread(single, least, ["route", "k1", "k2"], "n", "doc_id").where("first < doc_id").select("route", "first", "doc_id", "t", "run").distinct())
    parts = cut(claim.groupBy("route", "first").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")))
    asked = claim.join(sent(parts), ["route", "first"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "t", "run"), "parts").cast("int"))
    asked = asked.join(lead.select("route", "doc_id", "t", F.col("start").alias("run"), "words"), ["route", "doc_id", "t", "run"]).select("route", "first", "salt", F.lit(True).alias("asked"), "doc_id", "t", F.col("run").alias("start"), "words")
    index = parts.join(lead.select("route", F.col("doc_id").alias("first"), "t", "start", "words"), ["route", "first"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    index = index.select("route", "first", "salt", F.lit(False).alias("asked"), F.col("first").alias("doc_id"), "t", "start", "words")
    rows = index.unionByName(asked).repartition("route", "first", "salt").sortWithinPartitions("route", "first", "salt", "asked")
    return rows.mapInArrow(_stream(window), "doc_id long, t long, start long, end long")


def _ided(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (told, found).

    told: doc_id, t (a hash of the text), n_words, sha, copy (whether a smaller doc_id has the same words);
    found: doc_id, t, start, end, the words of windows that a smaller doc_id holds, for documents that aren't copies.
    """
    docs = _ided(docs)
    told = cut(docs.mapInArrow(_told(window, min(ANCHOR, window)), "doc_id long, t long, n_words long, sha binary, anchors array<long>, starts array<int>, ns array<int>"))
    same = cut(told.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    told = spread(told, same, ["sha"], "n", "doc_id").withColumn("copy", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)))
    own = told.where("rep IS NULL").unionByName(told.where("rep = doc_id").dropDuplicates(["sha"]))
    run = F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("starts").alias("start"), F.col("ns").alias("n")))
    own = own.select("doc_id", "t", run.alias("r")).select("doc_id", "t", "r.*")
    shared = own.groupBy("anchor").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "t")).alias("a"), F.max(F.struct("doc_id", "t")).alias("b")).where("a < b").select("anchor", "rows", F.lit(True).alias("met"))
    runs = spread(own, cut(shared), ["anchor"], "rows", "doc_id").where("met").groupBy("doc_id", "t").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    dealt = cut(docs.join(sent(cut(runs)), ["doc_id", "t"]).select("text", "doc_id", "t", "runs").mapInArrow(_runs(window), "route long, k1 long, k2 long, doc_id long, t long, start long, n long, words binary"))
    # of equal runs the first goes on, the others lose all their windows
    lead = dealt.groupBy("route", "k1", "k2").agg(F.min(F.struct("doc_id", "t", "start", "n", "words")).alias("x"), F.count("*").alias("rows"))
    lead = cut(lead.select("route", "k1", "k2", "rows", "x.*"))
    again = lead.where("rows > 1").select("route", "k1", "k2", "rows", F.col("doc_id").alias("first"))
    later = spread(dealt.drop("words"), cut(again), ["route", "k1", "k2"], "rows", "doc_id").where("first < doc_id").select("doc_id", "t", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    many = cut(lead.groupBy("route").agg(F.count("*").alias("unlike")).where(f"unlike > {shard}").select("route"))
    lone = lead.select("route", "doc_id", "t", "start", "words").join(sent(many), "route", "left_anti")
    found = lone.repartition("route").sortWithinPartitions("route", "doc_id").mapInArrow(_search(window, part), "doc_id long, t long, start long, end long")
    crowd = _crowded(lead.select("route", "doc_id", "t", "start", "words").join(sent(many), "route", "left_semi"), window, shard)
    return told.select("doc_id", "t", "n_words", "sha", "copy"), found.unionByName(later).unionByName(crowd)


def _strip(batches):
    """(doc_id, text, n_words, gone) -> doc_id, n_words, n_removed, kept_text."""
    for batch in batches:
        for rows, data, off in pieces(batch):
            raw = data.tobytes()
            removed, texts = [], []
            gone = rows.column("gone")
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                w = raw[a:b].split()
                keep = np.ones(len(w), bool)
                for x in gone[i].as_py() or ():
                    keep[x["start"] : x["end"]] = False
                removed.append(int((~keep).sum()))
                texts.append(b" ".join([w[j] for j in np.flatnonzero(keep).tolist()] if removed[-1] else w))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _digests(batches):
    """_strip with the digest of the text in its place."""
    for done in _strip(batches):
        sha = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in done.column("kept_text")]
        yield pa.RecordBatch.from_arrays([*done.columns[:3], pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _plan(docs: DataFrame, window: int, shard: int, part: int) -> DataFrame:
    """One row for each row of docs: doc_id, t, n_words, sha, whole (all words go) and gone, the (start, end) of words that go."""
    told, found = repeats(docs, window, shard, part)
    gone = cut(found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "end")).alias("gone")))
    whole = F.col("copy") & (F.col("n_words") >= window)
    return told.join(sent(gone), ["doc_id", "t"], "left").select("doc_id", "t", "n_words", "sha", whole.alias("whole"), F.when(~whole, F.col("gone")).alias("gone"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, part: int = PART) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, one row for each row; the words to keep themselves: strip()."""
    plan = cut(_plan(docs, window, shard, part))
    # texts are fetched for documents that lose some words, but not all
    some = cut(plan.where("gone IS NOT NULL").select("doc_id", "t", "n_words", "gone").dropDuplicates(["doc_id", "t"]))
    changed = _ided(docs).join(sent(some), ["doc_id", "t"]).select("doc_id", "text", "n_words", "gone").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    told = plan.where("gone IS NULL").select("doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"), F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    return told.unionByName(changed)


def strip(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, part: int = PART) -> DataFrame:
    """The texts left: docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text, for all documents."""
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    plan = _plan(docs, window, shard, part).select("doc_id", "t", "n_words", F.when(F.col("whole"), all_words).otherwise(F.col("gone")).alias("gone"))
    plan = cut(plan.dropDuplicates(["doc_id", "t"]))
    return _ided(docs).join(sent(plan), ["doc_id", "t"]).select("doc_id", "text", "n_words", "gone").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text string")
