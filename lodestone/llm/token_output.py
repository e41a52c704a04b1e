"""Token ids as binary files: static range asymmetric numeral system, in blocks that decode by themselves.

Texts are tokenised where they are read, an end id after each, and the ids are kept packed.
Their counts over all documents, one row an id, make the one table of frequencies that all
blocks share. The packed ids, not the texts, are ordered by range of doc_id; each task
codes its range into blocks of whole documents (at least `block` ids, but for a task's
last) as it reads on. A folder holds

  blocks/    Parquet: shard, block, start (ids of the shard before the block), n_docs, n_tokens, data (see _rans.py)
  table/     one row: the frequency table, with its checksum
  manifest/  shard, base (ids of all shards before it), n_tokens, n_docs; one row a shard

Spark's committer writes all of it, so a lost executor costs its tasks alone, and a folder
without manifest is an unfinished one. Readers take any blocks in any order, check the
three checksums of each and may begin a block at any of its checkpoints. Only counts (one
row an id of the vocabulary) and totals (one row a shard) reach the driver. A task holds a
block of ids, the longest document and what its tokenizer remembers.

Defined cases: a null text is empty and holds its end id alone; null doc_ids come first;
rows that repeat a doc_id are documents of their own, ordered by a hash of the text, then
by where they stand; an empty table gives an empty folder that reads back as no rows; ids
that the end id equals are told by the lengths that blocks keep; other columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _rans
from ._cut import shared_folder
from ._text import pieces
from ._tokens import encoder

#: ids of a block, at least
BLOCK = 1 << 19
#: bytes of text that are tokenised at once
PIECE = 2 << 20


def _packed(ids: np.ndarray, of: np.ndarray) -> Iterator[bytes]:
    """The ids of each document, deflated, two bytes each where all are under 65,536."""
    raw = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
    kind = bytes([raw.dtype.itemsize])
    at = 0
    for n in of.tolist():
        yield kind + zlib.compress(raw[at : at + n].tobytes(), 1)
        at += n


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(raw)[1:]), f"<u{raw[0]}").astype(np.uint32)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, h (of the text), n_tokens, ids (packed, the end id last) of each row of docs(doc_id, text)."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for rows, data, off in pieces(batch, size=PIECE):
                ids, n = enc.texts(data, off)
                ids = np.insert(ids, np.cumsum(n), end_id)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("h"), pa.array(n + 1), pa.array(list(_packed(ids, n + 1)), pa.binary())], ["doc_id", "h", "n_tokens", "ids"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return told.mapInArrow(run, "doc_id long, h long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs; counted within a task first."""

    def run(batches):
        found = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                more = np.bincount(unpacked(raw.as_py()))
                if len(more) > len(found):
                    found, more = more.astype(np.int64), found
                found[: len(more)] += more
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(tokens: DataFrame, table: bytes, block: int) -> DataFrame:
    def run(batches):
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def out():
            nonlocal number, start, held
            lengths = np.array([len(i) for _, i in held], np.int64)
            doc_ids, null = np.array([d or 0 for d, _ in held], np.int64), np.array([d is None for d, _ in held])
            data = _rans.encode(table, doc_ids, null, lengths, np.concatenate([i for _, i in held]))
            n = int(lengths.sum())
            row = pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "start": start, "n_docs": len(held), "n_tokens": n, "data": data}], schema)
            number, start, held = number + 1, start + n, []
            return row

        many = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append((doc_id, unpacked(raw.as_py())))
                many += len(held[-1][1])
                if many >= block:
                    yield out()
                    many = 0
        if held:
            yield out()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    ordered = tokens.withColumn("at", F.spark_partition_id()).repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    return ordered.select("doc_id", "ids").mapInArrow(run, "shard int, block long, start long, n_docs long, n_tokens long, data binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK) -> None:
    """All of docs(doc_id, text), tokenised, as a folder of blocks in ascending doc_id order."""
    spark = docs.sparkSession
    kept = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    # small row groups: a reader holds one at a time, and rows are long
    tokenize(docs, tokenizer, end_id).write.option("parquet.block.size", 8 << 20).option("compression", "uncompressed").parquet(kept)
    tokens = spark.read.parquet(kept)
    found = id_counts(tokens).collect()
    counts = np.zeros(1 + max([r.id for r in found], default=0), np.int64)
    counts[[r.id for r in found]] = [r.n for r in found]
    table = _rans.put_table(_rans.frequencies(counts))
    spark.createDataFrame([(bytearray(table),)], "data binary").coalesce(1).write.parquet(f"{folder}/table")
    _blocks(tokens, table, block).write.option("parquet.block.size", 8 << 20).option("compression", "uncompressed").parquet(f"{folder}/blocks")
    totals = sorted(spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.sum("n_docs").alias("d")).collect())
    rows, base = [], 0
    for shard, n, d in totals:
        rows.append((shard, base, n, d))
        base += n
    spark.createDataFrame(rows, "shard int, base long, n_tokens long, n_docs long").coalesce(1).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, decoded from the blocks of a folder."""
    table = bytes(spark.read.parquet(f"{folder}/table").first().data)
    base = {r.shard: r.base for r in spark.read.parquet(f"{folder}/manifest").collect()}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * ids)

    def run(batches):
        for batch in batches:
            for shard, start, data in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), batch.column("data"), strict=True):
                b = _rans.decode(table, data.as_py())
                end = np.cumsum(b.lengths)
                begin = end - b.lengths
                raw = memoryview(b.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                columns = [pa.array(b.doc_ids, pa.int64(), mask=b.null), pa.array(begin + start + base[shard]), pa.array(b.lengths), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(b.ids)).astype(np.int32)), pa.array(b.ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kept = spark.read.parquet(f"{folder}/blocks").select("shard", "start", "data")
    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
