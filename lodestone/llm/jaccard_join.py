"""N-gram Jaccard join with Bayesian pruning of candidate pairs.

1. Each document becomes its set of word shingles and HASHES MinHash values. Documents
   with equal sets are copies, one node; its representative is the smallest doc_id.
2. Bands of ROWS MinHash values deal nodes into buckets (a pair at the threshold 0.8
   meets in at least one of 24 bands but for 3 in a million).
3. In a bucket, pairs are compared a few MinHash values at a time and dropped as soon as
   the posterior probability (uniform prior, so Beta(m + 1, n - m + 1) after m of n
   agree) of reaching the threshold falls below TOLERANCE. What survives is not written
   out as pairs but as a spanning forest, so a dense bucket costs its size. In a bucket
   of more than BLOCK nodes each is first compared with the bucket's pivot: what survives
   hangs together by it and need not be compared among itself, the rest meets all.
4. Components of the forests are verified: each member's full shingle set is met, all
   pairs are counted exactly by blocked matrix products of the shingles that not all and
   not one alone have, and links are summed for each node. In a large component the
   shingles that most members have are its core text; members that lack r and add a of it
   with r + t a at most half of (1 - t) times its size are at least t alike each to each, so
   they are linked by that count, and pairs are met only where one of the two is no such member.

Large buckets and components are dealt in blocks, by number and by length, and each
pair of blocks is a task of its own: any size is done whole in bounded memory.

Defined cases: a null or empty text has no shingles, is a class of its own and has no
links; a text of fewer words than a shingle is one shingle; null doc_ids are dropped;
rows that repeat a doc_id count as one copy each if their texts agree and as documents of
their own if not; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._cut import cut, sent, spread
from ._text import SPACED, gram_hashes, mix64, pieces, spans, word_hashes

HASHES, ROWS, STEP, TOLERANCE, BLOCK = 96, 4, 16, 1e-6, 512
#: shingles of a block, and of a component that is met whole
WEIGHT = 1 << 18
_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, e, words = spans(data, off, SPACED)
    h = word_hashes(data, s, e)
    g = gram_hashes(h, n)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(n: int):
    def run(batches):
        for batch in batches:
            for rows, data, off in pieces(batch):
                sets = shingle_sets(rows, data, off, n)
                size = np.array([len(x) for x in sets])
                some = np.flatnonzero(size)
                low = np.zeros((HASHES, len(sets)), np.uint32)
                if len(some):
                    x = np.concatenate([sets[i] for i in some])
                    begin = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    for k in range(HASHES):
                        low[k, some] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begin)
                sums = [(int(mix64(y + np.uint64(7)).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix64(y ^ np.uint64(13)))) if len(y) else 0) for y in sets]
                wide = low.astype(np.uint64).reshape(HASHES // ROWS, ROWS, len(sets))
                key = np.zeros((HASHES // ROWS, len(sets)), np.uint64)
                for r in range(ROWS):
                    key = mix64(key + wide[:, r] + np.arange(HASHES // ROWS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * key.shape[0], pa.array(np.ascontiguousarray(key.T).ravel().view(np.int64)))
                short = np.ascontiguousarray(low.T.astype(np.uint16))
                sig = np.array(sums, np.uint64).reshape(-1, 2)
                node = mix64(sig[:, 0] ^ mix64(sig[:, 1] + size.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("t"), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), pa.array([r.tobytes() for r in short], pa.binary()), bands],
                    ["doc_id", "t", "node", "shingles", "minhash", "bands"],
                )

    return run


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared (STEP, 2 STEP, ...), the fewest agreements with which a pair stays."""
    x = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            p = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(p - p.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return out


def _labels(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member linked to each of m, by pairs."""
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the ends of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([np.asarray(batch.column(c), np.int64) for c in keys], 1)
        edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and last != tuple(k[a]):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about `rows` rows that hold whole groups, with where the groups begin."""
    held: list[pa.Table] = []
    edge = [0]
    for t in _groups(batches, keys):
        held.append(t)
        edge.append(edge[-1] + len(t))
        if edge[-1] >= rows:
            yield pa.concat_tables(held), np.array(edge)
            held, edge = [], [0]
    if held:
        yield pa.concat_tables(held), np.array(edge)


def _survives(least: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of MinHash values x and y stay as pairs; values are compared a few at a time, for those that still stay."""
    at, agree = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, need in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        agree += (x[at, cols] == y[at, cols]).sum(1)
        at, agree = at[agree >= need], agree[agree >= need]
    return at


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune(threshold: float, tolerance: float):
    """Nodes of a bucket, or of two blocks of one, -> (a, b): a spanning forest of the pairs that stay."""
    least = least_matches(threshold, tolerance)

    def pruned(mh, i, j):
        stay = [k + _survives(least, mh[i[k : k + 65536]], mh[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
        stay = np.concatenate(stay) if stay else np.zeros(0, np.int64)
        return i[stay], j[stay]

    def large(mh, left, right):
        """All pairs of two lists of nodes; the first values are compared block by block."""
        own = left is right
        for at in range(0, len(left), 128):
            x = left[at : at + 128]
            agree = (mh[x, None, :STEP] == mh[None, right, :STEP]).sum(2)
            i, j = np.nonzero((agree >= least[0]) & (right[None, :] > x[:, None] if own else True))
            yield pruned(mh, x[i], right[j])

    def run(batches):
        for t, edge in _chunks(batches, ("key", "lo", "hi")):
            ids = np.asarray(t["node"], np.int64)
            mh = _values(t["minhash"])
            lo, hi, side = (np.asarray(t[c], np.int64) for c in ("lo", "hi", "block"))
            begin, size = edge[:-1], np.diff(edge)
            whole = lo[begin] == hi[begin]
            pairs = []
            for m in range(2, 17):  # all small buckets of one size at once
                s = begin[whole & (size == m)]
                if len(s):
                    i, j = np.triu_indices(m, 1)
                    pairs.append(pruned(mh, (s[:, None] + i).ravel(), (s[:, None] + j).ravel()))
            for g in np.flatnonzero((size > 16) | (~whole & (size > 1))).tolist():
                at = np.arange(begin[g], begin[g] + size[g])
                if whole[g]:
                    pairs += large(mh, at, at)
                else:
                    pairs += large(mh, at[side[at] == lo[at[0]]], at[side[at] == hi[at[0]]])
            if pairs:
                label = _labels(len(ids), np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))
                own = np.flatnonzero(label != np.arange(len(ids)))
                u = np.unique(np.stack([ids[own], ids[label[own]]], 1), axis=0)
                u = u[u[:, 0] != u[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0].copy()), pa.array(u[:, 1].copy())], ["a", "b"])

    return run


def _near_pivot(threshold: float, tolerance: float):
    """(key, node, minhash, pivot, with_pivot) -> key, node, minhash, pivot, near: whether the pair with the pivot stays."""
    least = least_matches(threshold, tolerance)

    def run(batches):
        for batch in batches:
            near = np.zeros(len(batch), bool)
            if len(batch):
                near[_survives(least, _values(batch.column("minhash")), _values(batch.column("with_pivot")))] = True
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "node", "minhash", "pivot")], pa.array(near)], ["key", "node", "minhash", "pivot", "near"])

    return run


def _sets(n: int):
    """(text, node, key, copies, size) -> the same with the shingles in place of the text."""

    def run(batches):
        for batch in batches:
            for rows, data, off in pieces(batch):
                sets = [x.tobytes() for x in shingle_sets(rows, data, off, n)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("node", "key", "copies", "size")], pa.array(sets, pa.binary())], ["node", "key", "copies", "size", "shingles"])

    return run


def _occurrences(batches):
    """(key, shingles) -> key, s, n: how many of the sets of a batch have a shingle."""
    for batch in batches:
        key = np.asarray(batch.column("key"), np.int64)
        for k in np.unique(key).tolist():
            at = np.flatnonzero(key == k)
            for i in range(0, len(at), 256):
                u, n = np.unique(np.concatenate([np.frombuffer(batch.column("shingles")[j].as_py(), np.int64) for j in at[i : i + 256].tolist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k)), pa.array(u), pa.array(n)], ["key", "s", "n"])


def _within(threshold: float):
    """(node, key, copies, size, shingles, core) -> node, key, copies, size, shingles, near: whether the set is near enough to the core for all such sets to be linked."""

    def run(batches):
        for batch in batches:
            near = []
            for i in range(len(batch)):
                core = np.asarray(batch.column("core")[i].values, np.int64)
                own = np.frombuffer(batch.column("shingles")[i].as_py(), np.int64)
                both = len(np.intersect1d(core, own, assume_unique=True))
                near.append((len(core) - both) + threshold * (len(own) - both) <= (1 - threshold) * len(core) / 2 - 1e-9)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "key", "copies", "size", "shingles")], pa.array(near, pa.bool_())], ["node", "key", "copies", "size", "shingles", "near"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: what all have counts once, what one alone has not at all, the rest by blocked products."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    flat, member = np.concatenate(sets), np.repeat(np.arange(m), size)
    u, i, n = np.unique(flat, return_inverse=True, return_counts=True)
    some = (n > 1) & (n < m)
    place = np.cumsum(some) - 1
    keep = some[i]
    row, col = member[keep], place[i[keep]]
    out = np.full((m, m), float((n == m).sum()), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for a in range(0, int(some.sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        x = np.zeros((m, min(width, int(some.sum()) - a)), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    """Members of a component, or of two blocks of one, -> (node, links, to): linked copies of others, and a spanning forest of the links."""

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        for t in _groups(batches, ("key", "lo", "hi")):
            ids = np.asarray(t["node"], np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets], float)
            copies, side = np.asarray(t["copies"], np.int64), np.asarray(t["block"], np.int64)
            common = _common(sets).astype(float)
            linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if t["lo"][0].as_py() != t["hi"][0].as_py():
                linked &= side[:, None] != side[None, :]
            label = _labels(len(ids), *np.nonzero(linked))
            out[0].append(ids)
            out[1].append(linked @ copies)
            out[2].append(ids[label])
            if sum(map(len, out[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["node", "links", "to"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["node", "links", "to"])

    return run


def _in_blocks(df: DataFrame, size: Column, block: int) -> DataFrame:
    """df(key, node, near, ...) with block, lo and hi: each row once for each pair of blocks (lo, hi) that its own block is in, but for pairs of two near ones."""
    blocks = lambda near: F.coalesce(F.ceil(F.greatest(F.count_if(near) / block, F.sum(F.when(near, size)) / WEIGHT)), F.lit(0)).cast("int")
    df = cut(df)
    many = cut(df.groupBy("key").agg(blocks(~F.col("near")).alias("_p"), blocks(F.col("near")).alias("_q")))
    df = df.join(sent(many), "key").where("_p > 0")
    own = F.when(F.col("near"), F.col("_p") + F.pmod(F.xxhash64("node"), F.greatest("_q", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("_p")))
    df = df.withColumn("block", own.cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("_p")).otherwise(F.col("_p") + F.col("_q")) - 1)))
    return df.withColumn("lo", F.least("block", "_j")).withColumn("hi", F.greatest("block", "_j")).drop("_p", "_q", "_j", "near")


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(0) for c in ("block", "lo", "hi")})


def _by_group(df: DataFrame) -> DataFrame:
    return df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _candidates(sketched: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """sketched(node, minhash, bands) -> a, b: a spanning forest of the pairs that stay in some band."""
    banded = sketched.select(F.explode("bands").alias("key"), "node")
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1"))
    mh = sketched.select("node", "minhash")
    met = spread(banded, shared, ["key"], "members", "node").where("members IS NOT NULL").join(mh, "node")
    columns = ("key", "lo", "hi", "block", "node", "minhash")
    edges = _by_group(_whole(met.where(f"members <= {block}")).select(*columns)).mapInArrow(_prune(threshold, tolerance), "a long, b long")
    crowded = shared.where(f"members > {block}")
    if crowded.isEmpty():
        return edges
    pivots = cut(crowded.select("key", F.col("pivot").alias("node")).join(mh.withColumnRenamed("minhash", "with_pivot"), "node").select("key", "with_pivot"))
    asked = met.where(f"members > {block}").join(sent(pivots), "key").select("key", "node", "minhash", "pivot", "with_pivot")
    told = cut(asked.mapInArrow(_near_pivot(threshold, tolerance), "key long, node long, minhash binary, pivot long, near boolean"))
    star = told.where("near AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = _by_group(_in_blocks(told, F.lit(0), block).select(*columns)).mapInArrow(_prune(threshold, tolerance), "a long, b long")
    return edges.unionByName(star).unionByName(rest)


def _links(sets: DataFrame, sizes: DataFrame, threshold: float, block: int) -> DataFrame:
    """sets(node, key, copies, size, shingles), sizes(key, members, large) -> node, links, to."""
    columns = ("key", "lo", "hi", "block", "node", "copies", "shingles")
    kind = "node long, links long, to long"
    plain = sets.join(sent(sizes.where("NOT large").select("key")), "key", "left_semi")
    links = _by_group(_whole(plain).select(*columns)).mapInArrow(_verify(threshold), kind)
    large = cut(sizes.where("large"))
    if large.isEmpty():
        return links
    crowd = sets.join(F.broadcast(large.select("key")) if large.count() <= 1_000_000 else large.select("key"), "key", "left_semi")
    counts = crowd.select("key", "shingles").mapInArrow(_occurrences, "key long, s long, n long").groupBy("key", "s").agg(F.sum("n").alias("n"))
    core = counts.join(sent(large), "key").where("2 * n > members").groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("core"))
    core = cut(large.join(core, "key", "left").select("key", "members", F.coalesce("core", F.array().cast("array<long>")).alias("core")))
    told = cut(spread(crowd, core, ["key"], "members", "node").select("node", "key", "copies", "size", "shingles", "core").mapInArrow(_within(threshold), "node long, key long, copies long, size long, shingles binary, near boolean"))
    together = cut(told.where("near").groupBy("key").agg(F.sum("copies").alias("all"), F.min("node").alias("to")))
    among = told.where("near").select("node", "key", "copies").join(sent(together), "key").select("node", (F.col("all") - F.col("copies")).alias("links"), "to")
    rest = _by_group(_in_blocks(told, F.col("size"), block).select(*columns)).mapInArrow(_verify(threshold), kind)
    return links.unionByName(among).unionByName(rest)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))


def classes(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, t (a hash of the text), rep_id, class_id, n_links; one row for each row of docs.

    rep_id: the smallest doc_id with the same shingle set; class_id: the smallest doc_id
    reached over links; n_links: the number of other documents at least `threshold` alike.
    """
    docs = _hashed(docs)
    told = cut(docs.mapInArrow(_sketch(shingle), "doc_id long, t long, node long, shingles long, minhash binary, bands array<long>"))
    full = told.where("shingles > 0")
    same = cut(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    full = spread(full, same, ["node"], "copies", "doc_id")
    what = ["node", "doc_id", "t", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "shingles", "minhash", "bands"]
    sketched = cut(full.where("rep IS NULL").select(*what).unionByName(full.where("rep = doc_id").select(*what).dropDuplicates(["node"])))
    labels = cut(components(_candidates(sketched, threshold, tolerance, block)))
    member = sketched.join(labels, "node").select("node", F.col("label").alias("key"), "doc_id", "t", "copies", F.col("shingles").alias("size"))
    member = cut(member)
    sizes = member.groupBy("key").agg(F.count("*").alias("members"), F.sum("size").alias("weight"))
    sizes = cut(sizes.select("key", "members", ((F.col("members") > block) | (F.col("weight") > 4 * WEIGHT)).alias("large")))
    sets = docs.join(sent(member), ["doc_id", "t"]).select("text", "node", "key", "copies", "size").mapInArrow(_sets(shingle), "node long, key long, copies long, size long, shingles binary")
    sets = cut(sets)
    sets = sets.where("copies = 1").unionByName(sets.where("copies > 1").dropDuplicates(["node"]))  # a row may be repeated
    seen = cut(_links(sets, sizes, threshold, block))
    links = seen.groupBy("node").agg(F.sum("links").alias("links"))
    linked = cut(components(seen.where("node <> `to`").select(F.col("node").alias("a"), F.col("to").alias("b"))))
    least = linked.join(member.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    known = member.select("node", "copies").join(links, "node").join(linked.join(least, "label"), "node", "left").select("node", "links", "class_id", "copies")
    known = cut(known.withColumnRenamed("copies", "rows"))
    rep = F.coalesce("rep", "doc_id")
    out = spread(full.select("doc_id", "t", "node", "rep", "copies"), known, ["node"], "rows", "doc_id")
    out = out.select("doc_id", "t", rep.alias("rep_id"), F.coalesce("class_id", rep).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"))
    none = told.where("shingles = 0").select("doc_id", "t", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none)


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """docs(doc_id, text) -> doc_id, rep_id, class_id, n_links, as classes() has them."""
    return classes(docs, **settings).drop("t")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """docs, all columns: of each class the document with the smallest doc_id, once if its row is repeated; rows with a null doc_id all stay."""
    told = cut(classes(docs, **settings))
    own = docs.withColumn("_row", F.struct("*")).select("_row", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"))
    later = cut(told.where("class_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct())
    rows = own.join(sent(later), (own._id == later._id) & (own._t == later._t), "left_anti")
    twice = cut(told.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if not twice.isEmpty():
        twice = sent(twice)
        rows = rows.join(twice, ["_id", "_t"], "left_anti").unionByName(rows.join(twice, ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]))
    return rows.select("_row.*")
