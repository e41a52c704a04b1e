"""Rolling windows and the prefix trie against brute force, and their defined cases."""

import collections
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from lodestone.llm import prefix_trie, queries, rolling

SF = "/root/testdata/sf0.001"


def event_s(doc_id):
    return 60 * ((doc_id + zlib.crc32(str(doc_id).encode()) % 10000) // 6)


def windows_of(rows, windows):
    out = []
    by = collections.defaultdict(list)
    for d, s, lang, text in rows:
        if d is not None:
            by[s].append((event_s(d), lang, None if text is None else len(text)))
    for d, s, _, _ in rows:
        for w in windows:
            if d is None:
                out.append((d, w, None, 0, 0, 0, None, None))
                continue
            t = event_s(d)
            near = [x for x in by[s] if t - w <= x[0] < t]
            n = sorted(x[2] for x in near if x[2] is not None)
            m = len(n)
            out.append((d, w, t, len(near), sum(n), len({x[1] for x in near if x[1] is not None}), n[-(-m // 2) - 1] if m else None, n[-(-90 * m // 100) - 1] if m else None))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars").collect()), key=str)


@pytest.mark.parametrize(("windows", "block"), [((600, 43200), None), ((60, 1200, 6000), 7), ((600, 43200), 2000)])
def test_rolling(spark, windows, block):
    r = random.Random(5)
    rows = [(i * 3 - 40, r.choice(["a", "b", None, "a"]), r.choice(["en", "de", None, "fr"]), r.choice([None, "", "x" * r.randint(1, 900), "é😀"])) for i in range(600)]
    rows += [rows[7]] * 40 + [(None, "a", "en", "text"), (None, None, None, None), (50, "n", "en", "t" * 50000)]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, source string, lang string, text string, minute int, key string").repartition(4)
    assert told(rolling.rolling(docs, windows, block)) == windows_of(rows, windows)


def test_rolling_hot_minute(spark):
    """A third of the rows are one row, repeated; it goes to several tasks."""
    rows = [(1, "a", "en", "abc")] * 3000 + [(i, "a", "de", "x" * (i % 50)) for i in range(2, 3000, 7)]
    assert told(rolling.rolling(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"))) == windows_of_fast(rows)


def windows_of_fast(rows):
    each = {(d, w): out for d, w, *out in windows_of_unique(rows)}
    return sorted(((d, w, *each[d, w]) for d, *_ in rows for w in rolling.WINDOWS), key=str)


def windows_of_unique(rows):
    unique = list(dict.fromkeys(rows))
    times = collections.Counter(rows)
    for d, s, _, _ in unique:
        for w in rolling.WINDOWS:
            t = event_s(d)
            near = [(x, n) for x, n in times.items() if x[1] == s and t - w <= event_s(x[0]) < t]
            n = sorted(len(x[3]) for x, k in near for _ in range(k))
            m = len(n)
            yield d, w, t, m, sum(n), len({x[2] for x, _ in near}), n[-(-m // 2) - 1] if m else None, n[-(-90 * m // 100) - 1] if m else None


def test_rolling_many_lengths():
    """Ranks over more lengths than one coarse sum holds."""
    r = random.Random(2)
    panes = [(m, [r.randint(0, 5000) for _ in range(r.randint(0, 40))]) for m in range(100)]
    rows = []
    for m, x in panes:
        c = sorted(collections.Counter(x).items())
        rows.append({"minute": m, "n": len(x), "total": sum(x), "labels": [f"l{m % 3}"], "lengths": [a for a, _ in c], "counts": [b for _, b in c]})
    schema = pa.schema([("minute", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("labels", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    for got in rolling.slide(pa.Table.from_pylist(rows, schema=schema), 30, 90, (300, 3000)):
        for i, w in enumerate((5, 50)):
            near = sorted(v for m, x in panes if got["minute"] - w <= m < got["minute"] for v in x)
            assert (got["n_events"][i], got["sum_chars"][i]) == (len(near), sum(near))
            if near:
                assert got["median_chars"][i] == near[-(-len(near) // 2) - 1] and got["high_chars"][i] == near[-(-90 * len(near) // 100) - 1]


def test_rolling_empty(spark):
    assert rolling.rolling(spark.createDataFrame([], "doc_id long, source string, lang string, text string")).collect() == []


def test_rolling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    assert told(queries.op11_rolling(spark, SF)) == windows_of(rows, rolling.WINDOWS)


def trie_of(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).hexdigest(), text or ""))
    paths = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in paths:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(paths.get(base, [])[:h] + paths[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        worth = (len(m) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += worth
            leaves[k[:d]] += k not in children
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def nodes(spark, rows, schema="conv_id long, turn long, role string, text string"):
    found = prefix_trie.turns(spark.createDataFrame(rows, schema).repartition(3))
    out = prefix_trie.trie(*prefix_trie.rebuilt(found))
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


@pytest.mark.parametrize("segment", [2, 4096])
def test_trie(spark, monkeypatch, segment):
    """Any depth of sharing; in short stretches too."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SPAN", 4 if segment == 2 else 1 << 16)
    r = random.Random(8)
    rows = []
    for c in [*range(-25, 90), 400, 1000]:
        for turn in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if r.random() < 0.1 else turn, r.choice(["user", "assistant", None]), r.choice(["a", "b b", None, "c\tc c", ""])))
    rows += [(7, i, "user", "long " * (i % 4)) for i in range(60)] + [(12, i, "user", "a") for i in range(30)] + [(None, 0, "user", "x")] + rows[:5]
    assert nodes(spark, rows) == trie_of(rows)


def test_trie_peels_side_branches(spark):
    """Each conversation leaves the one before it a turn later: as many rounds as branches, and right."""
    rows = [(c * 20 + k, t, "user", "a" if t < c else f"b{c}") for c in range(9) for k in (0, 3) for t in range(c + 2)]
    assert nodes(spark, rows) == trie_of(rows)


def test_trie_of_copies_and_clashing_columns(spark):
    rows = [(c, t, "user", "same words here") for c in range(300) for t in range(3)]
    wide = [(*x, 1, 2, "z") for x in rows]
    assert nodes(spark, wide, "conv_id long, turn long, role string, text string, depth int, pos int, k1 string") == trie_of(rows)


def test_trie_empty(spark):
    assert nodes(spark, []) == []


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, SF)
    assert sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())) == trie_of(rows)
