"""Line dedup: pairwise alignment of documents that share lines.

1. Texts become arrays of line hashes. Of equal texts the smallest doc_id is aligned for
   all; the later ones are aligned whole, so they lose every line. From here on a
   document is a distinct text, known by its digest and ordered by its smallest doc_id.
2. A seed is a line of MIN_BYTES bytes beside whitespace, or the shortest run of shorter
   lines, from one with ink on, that has as many. A seed is shared if two distinct texts
   have it, however many do. Each document is paired with the first document of each of
   its shared seeds: as many pairs as seeds, whatever the size of a group.
3. A pair is aligned with patience diff (common ends, then the longest increasing run of
   lines unique in both, then the gaps between). Blocks of aligned lines that hold a
   shared seed are deleted from the later document.
4. Seeds that patience diff leaves unaligned (repeated or in another order in the first
   document) are then matched by content within the pair: the longest common block around
   each place of the seed is deleted. So a shared seed stays in its first document alone,
   and each deleted line stays in the first document that has it.

Only line hashes are shuffled for alignment, an earlier document's once for DEAL pairs; a
text is shuffled only if some of its lines go. Seeds that very many texts share (over HOT)
and documents that are first for many are dealt out by themselves.

Defined cases: a null text has no lines and stays null; an empty text has one empty
line; blank lines and runs of under MIN_BYTES seed nothing but go with a block around
them; lines repeated within one document alone stay; null doc_ids are dropped; rows that
repeat a doc_id and its text are one document and get the same answer each, with another
text they are documents of their own, the smaller digest first; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import cut, sent, spread
from ._text import BASE, BASE_INV, SPACED, U, mix64, pieces, powers, word_hashes

MIN_BYTES, HOT, DEAL, FLUSH = 12, 2_048, 512, 20_000


def _line_spans(data: np.ndarray, off: np.ndarray):
    """Starts and ends of lines, and where each text's lines begin among them; an empty text has one."""
    nl = np.flatnonzero(data == 0x0A)
    n = np.searchsorted(nl, off[1:]) - np.searchsorted(nl, off[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = off[:-1]
    ends[first[1:] - 1] = off[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = nl + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[inner] = nl
    return starts, ends, first


def _widths(ink: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many lines the seed at each line has; 0 where none starts."""
    total = np.concatenate([[0], np.cumsum(ink)])
    long = ink >= MIN_BYTES
    at = np.arange(len(ink))
    end = np.searchsorted(total, total[:-1] + MIN_BYTES)  # the least end with ink enough
    stop = np.repeat(first[1:], np.diff(first))
    longs = np.concatenate([[0], np.cumsum(long)])
    run = (ink > 0) & ~long & (end <= stop)
    run[run] = longs[end[run]] == longs[at[run]]
    return np.where(long, 1, np.where(run, end - at, 0)).astype(np.int32)


def _seeds(h: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of one text; a line's own hash if the seed is one line."""
    at = np.flatnonzero(width)
    w = width[at].astype(np.int64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    runs = mix64((total[at + w] - total[at]) * powers(BASE_INV, len(h))[at] + w.astype(U))
    return at, np.where(w == 1, h[at], runs).view(np.int64)


def _lines(batches):
    for batch in batches:
        batch = batch.filter(batch.column("text").is_valid())
        for rows, data, off in pieces(batch):
            s, e, first = _line_spans(data, off)
            h = word_hashes(data, s, e)
            ink = np.concatenate([[0], np.cumsum(SPACED[data])])
            width = _widths(ink[e] - ink[s], first)
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            at = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(sha, pa.binary()), pa.array(np.diff(first)), pa.array([h[a:b].tobytes() for a, b in at], pa.binary()), pa.array([width[a:b].tobytes() for a, b in at], pa.binary()), pa.array([np.unique(_seeds(h[a:b], width[a:b])[1]) for a, b in at], pa.list_(pa.int64()))],
                ["doc_id", "sha", "n_lines", "lines", "widths", "seeds"],
            )


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal lines, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        there: dict[int, int] = {}
        for j in range(b0, b1):
            if once.get(b[j], -1) >= 0:
                there[b[j]] = -1 if b[j] in there else j
        pairs = sorted((once[k], j) for k, j in there.items() if j >= 0)
        if not pairs:
            continue
        tops: list[int] = []  # longest increasing run of j
        ends: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tops, j)
            back[k] = ends[p - 1] if p else -1
            tops[p : p + 1], ends[p : p + 1] = [j], [k]
        run, k = [], ends[-1]
        while k >= 0:
            run.append(pairs[k])
            k = back[k]
        i0, j0 = a0, b0
        for i, j in [*reversed(run), (a1, b1)]:
            todo.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _around(a: list[int], b: list[int], i: int, least: int, places: set[int]) -> tuple[int, int]:
    """The longest block of a around i, from least on, that b has around one of the places."""
    best = (i, i)
    for j in sorted(places):
        p, q = 0, 0
        while i - p > least and j - p > 0 and a[i - p - 1] == b[j - p - 1]:
            p += 1
        while i + q < len(a) and j + q < len(b) and a[i + q] == b[j + q]:
            q += 1
        if p + q > best[1] - best[0]:
            best = (i - p, i + q)
    return best


def align(x: bytes, wx: bytes, y: bytes, wy: bytes, rare: list[int]) -> list[tuple[int, int]]:
    """Blocks of x to delete, as it has them in common with the earlier y, which is the first to hold the seeds `rare`."""
    ha, hb = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    wa = np.frombuffer(wx, np.int32)
    at, seed = _seeds(ha, wa)
    keep = np.isin(seed, np.array(rare, np.int64))
    at, seed = at[keep].tolist(), seed[keep].tolist()
    a, b = ha.tolist(), hb.tolist()
    pairs, blocks, k = patience(a, b), [], 0
    begin = np.zeros(len(a) + 1, np.int64)  # seeds that start before each line
    begin[1:] = np.cumsum(np.bincount(at, minlength=len(a))[: len(a)])
    width = wa.tolist()
    while k < len(pairs):
        n = k
        while n + 1 < len(pairs) and pairs[n + 1][0] == pairs[n][0] + 1 and pairs[n + 1][1] == pairs[n][1] + 1:
            n += 1
        s, e = pairs[k][0], pairs[n][0] + 1
        if any(i + width[i] <= e for i in at[begin[s] : begin[e]]):
            blocks.append((s, e))
        k = n + 1
    gone = np.zeros(len(a) + 1, np.int64)
    for s, e in blocks:
        gone[s + 1 : e + 1] = 1
    gone = np.cumsum(gone)
    left = [(i, v) for i, v in zip(at, seed, strict=True) if gone[i + width[i]] - gone[i] < width[i]]
    if left:
        # a seed's places in y: the first with the same line before, behind, or any; more would cost the square of its repeats
        where: dict[tuple, int] = {}
        keys = lambda z, i, n, v: [(v, 0), (v, 1, z[i - 1] if i else None), (v, 2, z[i + n] if i + n < len(z) else None)]
        wb = np.frombuffer(wy, np.int32).tolist()
        for j, v in zip(*(z.tolist() for z in _seeds(hb, np.frombuffer(wy, np.int32))), strict=True):
            for key in keys(b, j, wb[j], v):
                where.setdefault(key, j)
        done = 0  # what lies before is settled
        for i, v in left:
            if i + width[i] > done:
                s, done = _around(a, b, i, min(done, i), {where[key] for key in keys(a, i, width[i], v) if key in where})
                blocks.append((s, done))
    return blocks


def _align(batches):
    """Rows (first, part, doc, lines, widths, rare), a first holder (null doc) before its pairs -> (doc, start, end): lines to delete."""
    held, out = None, ([], [], [])

    def flush():
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc", "start", "end"])
        for x in out:
            x.clear()
        return done

    for batch in batches:
        names = ("first", "doc", "lines", "widths", "rare")
        for i in range(len(batch)):  # row by row: what a batch holds is not copied
            first, doc, lines, widths, rare = (batch.column(c)[i].as_py() for c in names)
            if doc is None:
                held = (first, lines, widths)
                continue
            if held is None or held[0] != first:
                raise ValueError("a pair without its first holder")
            for row in ((doc, s, e) for s, e in align(lines, widths, held[1], held[2], rare)):
                for x, y in zip(out, row, strict=True):
                    x.append(y)
            if len(out[0]) > FLUSH:
                yield flush()
    yield flush()


def _aligned(own: DataFrame, held: DataFrame) -> DataFrame:
    """held(doc, rank, line), each document with the first that holds the same line -> doc, start, end of _align."""
    rare = cut(held.groupBy("line").agg(F.count("*").alias("df"), F.min("rank").alias("first")).where("df > 1"))
    hot = sent(rare.where(f"df > {HOT}").select("line", "first"))
    met = held.join(hot, "line").unionByName(held.join(hot.select("line"), "line", "left_anti").join(rare.where(f"df <= {HOT}").select("line", "first"), "line"))
    pairs = cut(met.where("first < rank").groupBy("doc", F.col("first.sha").alias("first")).agg(F.collect_list("line").alias("rare")))
    # a document that is first for many is dealt to as many tasks, so that no task has all its pairs
    parts = pairs.groupBy("first").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts"))
    many = sent(cut(parts.where("parts > 1")))
    dealt = pairs.join(many, "first", "left").withColumn("part", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int"))
    later = dealt.join(own.select(F.col("sha").alias("doc"), "lines", "widths"), "doc").select("first", "part", "doc", "lines", "widths", "rare")
    holders = parts.join(own.select(F.col("sha").alias("first"), "lines", "widths"), "first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    holders = holders.select("first", "part", F.lit(None).cast("binary").alias("doc"), "lines", "widths", F.lit(None).cast("array<long>").alias("rare"))
    rows = holders.unionByName(later).repartition("first", "part").sortWithinPartitions("first", "part", F.col("doc").asc_nulls_first())
    return rows.mapInArrow(_align, "doc binary, start long, end long")


def common_blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (told, found): doc_id, sha, n_lines, rep (the smallest doc_id with the text); and sha, gone: the (start, end) lines to delete."""
    told = cut(docs.mapInArrow(_lines, "doc_id long, sha binary, n_lines long, lines binary, widths binary, seeds array<long>"))
    same = cut(told.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    at = spread(told, same, ["sha"], "n", "doc_id")
    what = ["sha", F.coalesce("rep", "doc_id").alias("rep"), "lines", "widths", "seeds"]
    own = cut(at.where("rep IS NULL").select(*what).unionByName(at.where("rep = doc_id").select(*what).dropDuplicates(["sha"])))
    rank = F.struct(F.col("rep").alias("rep"), F.col("sha").alias("sha")).alias("rank")
    found = _aligned(own, own.select(F.col("sha").alias("doc"), rank, F.explode("seeds").alias("line")))
    gone = found.groupBy(F.col("doc").alias("sha")).agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    return at.select("doc_id", "sha", "n_lines", F.coalesce("rep", "doc_id").alias("rep")), gone


def _cut_lines(batches):
    """(doc_id, text, gone) -> doc_id, n_lines, n_removed, kept: the text without the lines of gone."""
    for batch in batches:
        for rows, data, off in pieces(batch):
            s, e, first = _line_spans(data, off)
            raw, gone, there = data.tobytes(), rows.column("gone"), rows.column("text").is_valid().to_pylist()
            lines, removed, texts = np.diff(first), [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if not there[i]:
                    lines[i] = 0
                    removed.append(0)
                    texts.append(None)
                    continue
                spans = gone[i].as_py()
                if not spans:
                    removed.append(0)
                    texts.append(raw[off[i] : off[i + 1]])
                    continue
                keep = np.ones(b - a, bool)
                for x in spans:
                    keep[x["start"] : x["end"]] = False
                removed.append(int((~keep).sum()))
                texts.append(b"\n".join(raw[s[a + k] : e[a + k]] for k in np.flatnonzero(keep).tolist()))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rows.schema.names if c not in ("text", "gone")], pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], [*[c for c in rows.schema.names if c not in ("text", "gone")], "n_lines", "n_removed", "kept"])


def _digests(batches):
    """_cut_lines without the texts."""
    for done in _cut_lines(batches):
        sha = [hashlib.sha256(x.as_py().encode() if x.is_valid else b"").hexdigest() for x in done.column("kept")]
        yield pa.RecordBatch.from_arrays([done.column("doc_id"), done.column("n_lines"), done.column("n_removed"), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def _digest(name: str):
    """What _lines calls sha."""
    return F.unhex(F.sha2(name, 256))


def _ided(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")


def delete_blocks(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the blocks cut out of `text`; documents left without a line are dropped, rows with a null doc_id stay as they are."""
    told, found = common_blocks(_ided(docs))
    whole = told.where("rep < doc_id").select("doc_id", "sha").distinct().withColumn("copy", F.lit(True))
    some = told.where("rep = doc_id").select("doc_id", "sha").distinct().join(found, "sha").select("doc_id", "sha", "gone")
    plan = cut(whole.withColumn("gone", F.lit(None).cast(found.schema["gone"].dataType)).unionByName(some.withColumn("copy", F.lit(False))))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("sha"), F.struct("*").alias("row"))
    packed = row.join(sent(plan), ["doc_id", "sha"], "left").where("NOT coalesce(copy, false)").select("gone", "row")
    return packed.mapInArrow(_put_back, packed.select("row").schema).select("row.*")


def _put_back(batches):
    """(row, gone) -> row with the lines cut out of its text, if any is left; a row is held once, its text goes by piece."""
    for batch in batches:
        whole = batch.column("row")
        for i in range(0, len(batch), 1000):
            row = whole.slice(i, 1000)
            names = [f.name for f in row.type]
            text = pc.struct_field(row, "text")
            done = list(_cut_lines([pa.RecordBatch.from_arrays([text, batch.column("gone").slice(i, 1000)], ["text", "gone"])]))
            kept = pa.concat_arrays([d.column("kept") for d in done]).cast(text.type)
            own = pa.StructArray.from_arrays([kept if n == "text" else pc.struct_field(row, n) for n in names], fields=list(row.type))
            lines, removed = (np.concatenate([np.asarray(d.column(c)) for d in done]) for c in ("n_lines", "n_removed"))
            yield pa.RecordBatch.from_arrays([own.filter(pa.array((removed == 0) | (removed < lines)))], ["row"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_removed, kept_sha256, one row for each row; the texts left: delete_blocks()."""
    docs = _ided(docs)
    told, found = common_blocks(docs)
    told = cut(told)
    nothing = F.sha2(F.lit(""), 256)
    copies = told.where("rep < doc_id").select("doc_id", "n_lines", F.col("n_lines").alias("n_removed"), nothing.alias("kept_sha256"))
    first = told.where("rep = doc_id")
    # only texts that lose a part are fetched; rows that repeat a doc_id and its text are fetched once each
    plan = cut(first.select("doc_id", "sha").distinct().join(found, "sha"))
    texts = docs.withColumn("sha", _digest("text")).join(sent(plan), ["doc_id", "sha"]).select("doc_id", "text", "gone")
    some = texts.mapInArrow(_digests, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
    same = first.join(plan.select("doc_id", "sha"), ["doc_id", "sha"], "left_anti").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))
    none = docs.where("text IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), nothing.alias("kept_sha256"))
    return copies.unionByName(some).unionByName(same).unionByName(none)
