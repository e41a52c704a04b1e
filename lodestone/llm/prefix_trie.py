"""Conversation prefix trie: leaves are peeled, completed nodes send subtree totals to their parents.

A node is a distinct sequence of first turns. It is named by its smallest member and its
depth, and met by a 120-bit digest: digests of turns at their places, combined by XOR as a
running aggregate, so all prefixes of a conversation take one pass. On the way down the
smallest member changes only at some nodes; the nodes that one conversation names lie in
a row, each the parent of the next, and are peeled as one. Such a path holds a counter of
the paths that hang off it. A path whose counter is 0 is complete: it sends its
leaves and saved tokens to the path it hangs off, summed by receiver before they are
shuffled, which takes them off its counter. Rounds go on until only the root's path is left and
finishes. They number as often as the smallest member changes on one way, not the depth.
Totals of the nodes in a path are then running sums of their own counts and of what was
sent to them.

Running aggregates over a conversation or a path are made in stretches of SEGMENT turns,
then over stretches, so a conversation may hold any share of the rows. Members that end at
a node are joined to strings within spans of SPAN ids, and a node's strings are hashed as
they stream by, in order; no list of members is held.

Defined cases: turns go by turn (null first), then role, then MD5 of role and text; null
role or text is empty; rows without conv_id belong to no conversation and are left out;
repeated rows are turns of their own; an empty table has no node, not even a root; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cut import cut, spread

SEGMENT = 4096
SPAN = 1 << 16
_LONG = "long"


def _digest(*parts: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits."""
    m = F.md5(F.concat(*parts))
    return tuple(F.conv(F.substring(m, i, 15), 16, 10).cast(_LONG) for i in (1, 17))


def running(rows: DataFrame, key: str, order: Column, segment: Column, sums: dict[str, tuple[Callable, str]]) -> DataFrame:
    """rows with running aggregates, each a function that aggregates its own results, over a key in the order given; `segment` ascends with the order."""
    rows = rows.withColumn("_segment", segment)
    here = Window.partitionBy(key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_segment").agg(*[f(c).alias(f"_t_{n}") for n, (f, c) in sums.items()])
    totals = totals.select(key, "_segment", *[f(f"_t_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in sums.items()], F.row_number().over(Window.partitionBy(key).orderBy("_segment")).alias("_k"))
    told = rows.select("*", *[f(c).over(here).alias(n) for n, (f, c) in sums.items()]).join(totals.where("_k > 1").drop("_k"), [key, "_segment"], "left")
    both = {n: F.when(F.col(f"_b_{n}").isNull(), F.col(n)).otherwise(F.col(n).bitwiseXOR(F.col(f"_b_{n}")) if f is F.bit_xor else F.col(n) + F.col(f"_b_{n}")) for n, (f, _) in sums.items()}
    return told.withColumns(both).drop("_segment", *[f"_b_{n}" for n in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (digest of role and text) and words of each row of conversations(conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast(_LONG).alias("conv_id"), F.col("turn").cast(_LONG).alias("turn"), role.alias("role"), a.alias("a"), b.alias("b"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast(_LONG).alias("words"), F.lit(1).cast(_LONG).alias("one")
    )
    rows = cut(rows)
    segment = F.coalesce(F.col("turn") - F.pmod("turn", F.lit(SEGMENT)), F.lit(-(1 << 63)))
    order = [F.col("turn").asc_nulls_first(), "role", "a", "b"]
    return running(rows, "conv_id", order, segment, {"pos": (F.sum, "one")}).select("conv_id", "pos", "a", "b", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns(): conversations(conv_id, n_turns) and their turns, the first h taken from conversation conv_id - conv_id % 20, then their own after h; h is crc32(conv_id) mod 4."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    own = cut(rows.groupBy("conv_id").agg(F.max("pos").alias("n"))).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    bases = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    told = own.join(bases, "base", "left").select("conv_id", "n", "h", "base", F.least(F.col("h"), F.coalesce("base_n", F.lit(0).cast(_LONG))).alias("taken"))
    told = cut(told.withColumn("n_turns", F.col("taken") + F.greatest(F.lit(0).cast(_LONG), F.col("n") - F.col("h"))))
    heads = rows.where("conv_id % 20 = 0 AND pos <= 3").withColumnRenamed("conv_id", "base").join(told.select("conv_id", "h", "base", "n_turns"), "base").where("pos <= h")
    rest = spread(rows, told.select("conv_id", "n", "h", "taken", "n_turns"), ["conv_id"], "n", "pos").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "n_turns", "pos", "a", "b", "words"]
    return told.select("conv_id", "n_turns"), heads.select(*columns).unionByName(rest.select(*columns))


def _ends(last: DataFrame) -> DataFrame:
    """last(depth, k1, k2, conv_id) -> ends_sha256 of each node: its conv_ids ascending, joined by commas."""
    node = ["depth", "k1", "k2"]
    span = F.col("conv_id") - F.pmod("conv_id", F.lit(SPAN))
    text = last.groupBy(*node, span.alias("span")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        at, told = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids")), strict=True):
                if key == at:
                    told.update(b",")
                else:
                    if at is not None:
                        done.append((*at, told.hexdigest()))
                    at, told = key, hashlib.sha256()
                told.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), d, strict=True)) for d in done], schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), (*at, told.hexdigest()), strict=True))], schema)

    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return text.repartition(*node).sortWithinPartitions(*node, "span").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def peel(paths: DataFrame) -> DataFrame:
    """paths(path, parent, left, leaves, saved) -> path, leaves, saved over all that hangs off each; `left` counts the paths that hang off it."""
    state, done = cut(paths), []
    while not state.isEmpty():
        finished = state.where("left = 0")
        done.append(finished.select("path", "leaves", "saved"))
        sent = finished.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        more = state.where("left > 0").join(sent, "path", "left").na.fill(0, ["_n", "_leaves", "_saved"])
        state = cut(more.select("path", "parent", (F.col("left") - F.col("_n")).alias("left"), (F.col("leaves") + F.col("_leaves")).alias("leaves"), (F.col("saved") + F.col("_saved")).alias("saved")))
    return reduce(DataFrame.unionAll, done) if done else state.select("path", "leaves", "saved")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """convs(conv_id, n_turns), rows(conv_id, n_turns, pos, a, b, words) -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    placed = rows.select("conv_id", "n_turns", "pos", "words", F.xxhash64(F.lit(1), "pos", "a", "b").alias("x1"), F.xxhash64(F.lit(2), "b", "a", "pos").alias("x2"))
    prefixes = running(cut(placed), "conv_id", [F.col("pos")], F.col("pos") - F.pmod("pos", F.lit(SEGMENT)), {"k1": (F.bit_xor, "x1"), "k2": (F.bit_xor, "x2")})
    zero = F.lit(0).cast(_LONG)
    top = convs.select("conv_id", "n_turns", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    members = prefixes.select("conv_id", "n_turns", F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words")
    members = cut(members.unionByName(top))
    node = ["depth", "k1", "k2"]
    nodes = members.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = cut(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, node, "left").join(_ends(members.where("depth = n_turns").select(*node, "conv_id")), node, "left").na.fill(0, ["n_children"]))

    # where each conversation becomes the smallest member, and the path it hangs off there
    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("t")).select("conv_id", (F.col("t.depth") - 1).alias("depth"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"))
    named = nodes.where("n_children > 0").select(*node, F.col("conv_id").alias("parent"), "n_children")
    tops = cut(spread(tops, named, node, "n_children", "conv_id").select(F.col("conv_id").alias("path"), "parent", F.col("depth").alias("at")))
    own = nodes.groupBy(F.col("conv_id").alias("path")).agg(F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    hanging = tops.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("left"))
    totals = peel(tops.join(own, "path").join(hanging, "path", "left").select("path", "parent", F.coalesce("left", F.lit(0).cast(_LONG)).alias("left"), "leaves", "saved"))

    sent = totals.join(tops.where("parent IS NOT NULL"), "path").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    each = nodes.join(sent, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_convs", "n_children", "ends_sha256",
        (F.coalesce("_leaves", zero) + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), (F.coalesce("_saved", zero) + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    summed = running(cut(each), "conv_id", [F.col("depth").desc()], -(F.col("depth") - F.pmod("depth", F.lit(SEGMENT))), {"n_leaves": (F.sum, "leaves"), "saved_tokens": (F.sum, "saved")})
    starts = tops.select(F.col("path").alias("conv_id"), "parent", (F.col("at") + 1).alias("depth"), F.lit(True).alias("_top"))
    out = summed.join(starts, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", F.when(F.col("_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
