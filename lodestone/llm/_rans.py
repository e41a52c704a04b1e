"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

A frequency table is shared by all blocks and sums to 2 ** BITS. A block is coded by
itself: token i goes to lane i % lanes, each lane has a 64-bit state that gives and takes
32-bit words, and the words of one step of all lanes lie side by side, so that a step is
a handful of array operations. Every `every` steps a checkpoint holds all states and the
place in the words, so any stretch between checkpoints decodes by itself.

Layout of a block, little-endian: magic, then header (HEADER), doc ids (int64), a byte a
document (1: id is null), tokens a document (int64), words before each checkpoint
(uint32), states of each checkpoint (uint64), words (uint32). Of the checksums one covers
all that follows the header, one the ids.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BITS = 18
LANES = 1024
EVERY = 256
LOW = np.uint64(1 << 31)
_S32, _SB, _M32 = np.uint64(32), np.uint64(BITS), np.uint64((1 << 32) - 1)
_MASK, _PART = np.uint64((1 << BITS) - 1), np.uint64((1 << 21) - 1)
MAGIC = b"TRNS"
#: version, lanes, steps between checkpoints, documents, words, checkpoints, checksums of the table, of the ids, of the body; ids
HEADER = struct.Struct("<9IQ")
TABLE_MAGIC = b"TFRQ"
TABLE = struct.Struct("<IIII")


class Block(NamedTuple):
    doc_ids: np.ndarray
    null: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts of ids -> frequencies that sum to 2 ** BITS, at least 1 for each id that occurs, 0 for the others."""
    seen = counts > 0
    kinds = int(seen.sum())
    if kinds > 1 << (BITS - 1):
        raise ValueError(f"{kinds} ids are too many for tables of 2 ** {BITS}")
    out = np.zeros(len(counts), np.uint32)
    if not kinds:
        return out
    c, room, rare = counts[seen].astype(object), 1 << BITS, np.zeros(kinds, bool)
    while True:  # ids whose share is under 1 get 1, the others what is left, in proportion
        share = np.where(rare, 1, c * (room - int(rare.sum())) // int(c[~rare].sum() or 1))
        if (share > 0).all():
            break
        rare |= share == 0
    out[seen] = share.astype(np.uint32)
    out[int(np.argmax(counts))] += room - int(out.sum())
    return out


def put_table(freq: np.ndarray) -> bytes:
    body = freq.astype("<u4").tobytes()
    return TABLE_MAGIC + TABLE.pack(1, BITS, len(freq), zlib.crc32(body)) + body


def get_table(raw: bytes) -> np.ndarray:
    version, bits, n, crc = TABLE.unpack_from(raw, 4)
    body = raw[4 + TABLE.size :]
    if raw[:4] != TABLE_MAGIC or version != 1 or bits != BITS or len(body) != 4 * n or zlib.crc32(body) != crc:
        raise ValueError("this is no frequency table, or it is damaged")
    return np.frombuffer(body, "<u4")


@lru_cache(maxsize=2)
def _slots(raw: bytes) -> tuple[np.ndarray, ...]:
    freq = get_table(raw)
    f = freq.astype(np.uint64)
    c = np.cumsum(f) - f
    sym = np.repeat(np.arange(len(freq), dtype=np.uint64), freq)
    # id, frequency and place in the id's own range of each slot, packed so that a step looks up once
    packed = sym << np.uint64(42) | (f[sym] << np.uint64(21)) | (np.arange(len(sym), dtype=np.uint64) - c[sym])
    return f, c, packed, zlib.crc32(raw)


def encode(raw: bytes, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block: `ids` holds the tokens of all its documents, one after the other."""
    f, c, _, crc = _slots(raw)
    n = len(ids)
    while lanes > 1 and lanes * 64 > n:
        lanes //= 2
    fs = f[ids]
    if n and not fs.all():
        raise ValueError("an id has no place in the table")
    cs, full = c[ids], fs << np.uint64(31 - BITS + 32)
    x = np.full(lanes, LOW, np.uint64)
    steps = -(-n // lanes)
    groups, sizes, states = [], np.zeros(steps + 1, np.int64), []
    for t in range(steps - 1, -1, -1):
        a = t * lanes
        b = min(n, a + lanes)
        y = x[: b - a]
        out = y >= full[a:b]
        if out.any():
            groups.append((y[out] & _M32).astype(np.uint32))
            sizes[t] = len(groups[-1])
            y[out] >>= _S32
        q, r = np.divmod(y, fs[a:b])
        x[: b - a] = (q << _SB) + r + cs[a:b]
        if t % every == 0:
            states.append(x.copy())
    words = np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)
    before = (np.cumsum(sizes) - sizes)[:steps:every].astype("<u4")
    at = np.array(states[::-1], np.uint64).reshape(-1, lanes)
    body = b"".join((doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), lengths.astype("<i8").tobytes(), before.tobytes(), at.astype("<u8").tobytes(), words.astype("<u4").tobytes()))
    return MAGIC + HEADER.pack(1, lanes, every, len(doc_ids), len(words), len(before), crc, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body), n) + body


def _parse(block: bytes, crc: int):
    if block[:4] != MAGIC:
        raise ValueError("this is no block of tokens")
    version, lanes, every, docs, n_words, points, table, told, of_body, n = HEADER.unpack_from(block, 4)
    body = memoryview(block)[4 + HEADER.size :]
    if version != 1 or zlib.crc32(body) != of_body:
        raise ValueError("a block of tokens is damaged")
    if table != crc:
        raise ValueError("a block of tokens was written with another table")
    at, parts = 0, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u4", points), ("<u8", points * lanes), ("<u4", n_words)):
        size = np.dtype(kind).itemsize * k
        parts.append(np.frombuffer(body[at : at + size], kind))
        at += size
    return lanes, every, told, n, parts


def _stretch(tables, x: np.ndarray, words: np.ndarray, out: np.ndarray, lanes: int) -> None:
    packed = tables[2]
    x, p, n = x.astype(np.uint64), 0, len(out)
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        y = x[: b - a]
        slot = packed[y & _MASK]
        out[a:b] = slot >> np.uint64(42)
        y = ((slot >> np.uint64(21)) & _PART) * (y >> _SB) + (slot & _PART)
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << _S32) | words[p : p + len(low)]
            p += len(low)
        x[: b - a] = y


def checkpoints(raw: bytes, block: bytes) -> int:
    return len(_parse(block, _slots(raw)[3])[4][3])


def decode_from(raw: bytes, block: bytes, k: int) -> tuple[int, np.ndarray]:
    """(place in the block, ids) of the stretch that begins at checkpoint k; no other stretch is decoded."""
    tables = _slots(raw)
    lanes, every, _, n, (_, _, _, before, states, words) = _parse(block, tables[3])
    a = k * every * lanes
    out = np.empty(min(n - a, every * lanes), np.uint32)
    _stretch(tables, states[k * lanes : (k + 1) * lanes], words[before[k] :], out, lanes)
    return a, out


def decode(raw: bytes, block: bytes) -> Block:
    tables = _slots(raw)
    lanes, _, told, n, (doc_ids, null, lengths, _, states, words) = _parse(block, tables[3])
    out = np.empty(n, np.uint32)
    if n:
        _stretch(tables, states[:lanes], words, out, lanes)
    if zlib.crc32(out.astype("<u4").tobytes()) != told or int(lengths.sum()) != n:
        raise ValueError("a block of tokens does not give what was written")
    return Block(doc_ids, null.astype(bool), lengths, out)
