"""Token ids of Arrow text batches by a tokenizer file of the tokenizers library.

Where the file's pipeline drops white space and never joins what white space parts, a
text's ids are those of its words, one after the other. Then each word is encoded once by
a worker and remembered, and texts are put together by whole-array work. Words are told
apart by a hash and compared byte by byte, so equal hashes of unlike words do no harm.
Other files are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from ._text import word_hashes

#: words that one worker remembers; when it has as many, it begins anew
MEMO = 2_000_000
# fixed values: the parts of a pipeline under which words are encoded apart
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 0: white space, 1: letters under U+0100, 2: marks that end a run of letters, 3: all else
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[ord(c) for c in ".,;:!?"]] = 2
_MARKS = r"!-&(-/:;=?@\[-`{}~"  # of ASCII, all but ', which may begin a part, and < > |, which stand in special tokens
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[0-9{_MARKS}{_LATIN}]*")
_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|[{_MARKS}]+")


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each text's words begin among them. A word ends at white space, and between a letter under U+0100 and one of .,;:!?"""
    k = _CLASS[data]
    # letters from U+00C0 to U+00FF count as the ASCII ones
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    k[lead] = k[lead + 1] = 1
    before = np.zeros(len(k), np.uint8)
    before[1:] = k[:-1]
    first = off[:-1][off[:-1] < len(k)]
    before[first] = 0
    inside = k != 0
    begin = inside & ((before == 0) | ((k == 2) & (before == 1)))
    starts = np.flatnonzero(begin)
    stop = np.ones(len(k), bool)
    stop[:-1] = begin[1:] | ~inside[1:]
    edge = off[1:] - 1
    stop[edge[edge >= 0]] = True
    return starts, np.flatnonzero(inside & stop) + 1, np.searchsorted(starts, off)


def ragged(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[begin[i] : begin[i] + n[i]] for each i, one after the other."""
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values[np.repeat((begin - (end - n)).astype(kind), n) + np.arange(total, dtype=kind)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        told = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        self.by_word = (
            told == _NORMALIZERS and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == _SPLIT and parts[0]["behavior"] == "Removed" and parts[0]["invert"] is True
            and not parts[1]["add_prefix_space"] and parts[1].get("use_regex") is False and not model.get("continuing_subword_prefix") and not model.get("dropout") and not any(x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens", []))
        )
        if self.by_word:
            from tokenizers import pre_tokenizers

            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            # how the library spells bytes beyond ASCII, learnt from all two-byte letters under U+0250
            self.spelt = {chr(i): level.pre_tokenize_str(chr(i))[0][0] for i in range(0x61, 0x250) if chr(i).isalpha()}
            self.table = str.maketrans(self.spelt)
            self.model = self.full.model
        self.vocabulary = self.full.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known: list[pd.Index] = []  # of keys; their places go on from index to index
        self.begin, self.count, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.byte_begin, self.byte_count, self.bytes, self.byte_used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint8), 0

    def word(self, raw: bytes) -> list[int]:
        if raw.isalpha():
            return [t.id for t in self.model.tokenize(raw.decode().lower())]
        w = raw.decode("utf-8", "replace")
        # composed lower-case Latin letters, ASCII digits and most marks pass the normalizers unchanged and part as the pipeline parts them
        if _PLAIN.fullmatch(w):
            w = w if w.islower() else "".join(c.lower() if c < "\x80" else c for c in w)
            if w == w.lower() and unicodedata.is_normalized("NFC", w):
                return [t.id for part in _PARTS.findall(w) for t in self.model.tokenize(part if part.isascii() else part.translate(self.table))]
        return self.full.encode(w, add_special_tokens=False).ids

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        found = [self.word(w) for w in words]
        n, m = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, words), np.int64, len(words))
        flat, raw = np.fromiter((i for f in found for i in f), np.uint32, int(n.sum())), np.frombuffer(b"".join(words), np.uint8)
        k = len(self.begin)
        self.flat, self.bytes = _room(self.flat, self.used, flat), _room(self.bytes, self.byte_used, raw)
        self.begin, self.count = np.append(self.begin, self.used + np.cumsum(n) - n), np.append(self.count, n)
        self.byte_begin, self.byte_count = np.append(self.byte_begin, self.byte_used + np.cumsum(m) - m), np.append(self.byte_count, m)
        self.used, self.byte_used = self.used + len(flat), self.byte_used + len(raw)
        self.known.append(pd.Index(keys))
        while len(self.known) > 1 and len(self.known[-1]) * 4 > len(self.known[-2]):
            last = self.known.pop()
            self.known[-1] = self.known[-1].append(last)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key's word is remembered, -1 if it isn't."""
        out, first = np.full(len(keys), -1, np.int64), 0
        for some in self.known:
            left = np.flatnonzero(out < 0)
            at = some.get_indexer(keys[left])
            out[left] = np.where(at < 0, -1, at + first)
            first += len(some)
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        got = self._by_word(data, off) if self.by_word else None
        return self._whole(data, off) if got is None else got

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [self.full.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(off[:-1], off[1:], strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.uint32, int(n.sum())), n

    def _by_word(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        starts, ends, words = word_spans(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        size = ends - starts
        code, keys = pd.factorize(word_hashes(data, starts, ends))
        one = np.empty(len(keys), np.int64)
        one[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        # each word against the first of its hash
        if (size != size[one[code]]).any() or (ragged(data, starts, size) != ragged(data, starts[one[code]], size)).any():
            return None
        if len(self.begin) + len(keys) > MEMO:
            self._forget()
        place = self.places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            place[new] = len(self.begin) + np.arange(len(new))
            self._learn([raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)], keys[new])
        # and against the remembered one
        if (self.byte_count[place] != size[one]).any() or (ragged(self.bytes, self.byte_begin[place], size[one]) != ragged(data, starts[one], size[one])).any():
            return None
        of_word = self.count[place][code]
        ids = ragged(self.flat, self.begin[place][code], of_word)
        total = np.concatenate(([0], np.cumsum(of_word)))
        return ids, np.diff(total[words])


def _room(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(a):
        a = np.concatenate((a[:used], np.zeros(max(len(a), len(more)), a.dtype)))
    a[used : used + len(more)] = more
    return a


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker, which goes on from task to task."""
    return Encoder(path)
