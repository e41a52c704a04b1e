"""Words, word hashes and n-gram hashes of Arrow text batches, as whole-array numpy work.

A batch is cut into pieces of about PIECE bytes, so memory doesn't follow the size of
a batch; one text is never cut, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: bytes of words: all but ASCII whitespace
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words: ASCII letters and digits, all beyond ASCII
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    p = _powers.get(int(base))
    if p is None or len(p) < n:
        size = max(n, PIECE + 1)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if size <= 4 * PIECE:
            _powers[int(base)] = p
    return p[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows; nulls count as empty."""
    text = batch.column(column)
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin among them (one more entry than texts)."""
    m = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1]] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = m[:-1]
        before &= ~edge[:-1]
        after = np.empty(len(data), bool)
        after[-1] = False
        after[:-1] = m[1:] & ~edge[1:-1]
        starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * powers(BASE_INV, len(data) + 1)[starts]  # an empty line may start at the end
    return mix64(h + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; windows that cross texts are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out *= BASE
            out += h[i : len(h) - n + 1 + i]
        return mix64(out)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    return mix64((total[n:] - total[:-n]) * powers(BASE_INV, len(h) - n + 1))


def within(words: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive words of one text start, given where texts begin among the words."""
    count = int(words[-1])
    ok = np.ones(max(0, count - n + 1), bool)
    for b in range(1, n):
        cut = words[1:-1] - b
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return np.flatnonzero(ok)


def owner(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text in which each word position lies."""
    return np.searchsorted(words, at, "right") - 1
