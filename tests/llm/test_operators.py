"""Each operator against brute force, and the defined cases: nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontamination, exact_dedup, jaccard_join, line_dedup, lm_scoring, mixing, pii, substring_dedup, toxicity
from lodestone.llm._fm import Index

SCHEMA = "doc_id long, text string, source string, key string, spans int, h int, row int"


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    out = [None, "", " \t\n", "short", passage, passage, passage.replace(" ", "\n", 3)]
    for _ in range(25):
        t = [r.choice(vocab) for _ in range(r.randint(1, 60))]
        if r.random() < 0.5:
            t.insert(r.randrange(len(t)), passage)
        out.append(" ".join(t))
    out.append(out[-1] + " more")
    out.append("again " * 200)
    out.append("again " * 150)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else f"s{i % 3}", "k", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, block=4).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    per = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False).agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    assert ((per.t - per.k).abs() <= 8).all() and (per.t <= 2 * per.s + 1e-9).all()
    assert abs(per.t.sum() - 1.5 * per.s.sum()) < 1e-6
    assert mixing.mix(empty).count() == 0
    more = docs.unionByName(docs.where("doc_id % 4 = 0")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.repeat(F.lit("long text "), 50000)))
    told = [sorted(map(str, mixing.mix(x).select("doc_id", "size", "taken").collect())) for x in (more, more.repartition(7))]
    assert len(told[0]) == more.count() and told[0] == told[1]


def test_apportion(spark):
    """Seats by highest quotients, one by one, ties to the smaller order."""
    r = random.Random(21)
    rows, want = [], {}
    for g in range(120):
        claims = [r.choice([0, 0, 1, 1, 2, 5, 10, 100, 1000]) for _ in range(r.randrange(1, 9))]
        seats = r.choice([0, 1, 2, 3, 7, 20, 100])
        got = [0] * len(claims)
        for _ in range(seats if sum(claims) else 0):
            k = max(range(len(claims)), key=lambda i: (claims[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        rows += [(g, i, float(c), seats) for i, c in enumerate(claims)]
        want |= {(g, i): n for i, n in enumerate(got)}
    told = mixing.apportion(spark.createDataFrame(rows, "g int, o int, claim double, seats long"), "g", "claim", "o", "seats").collect()
    assert {(x.g, x.o): x.quota for x in told} == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, texts, empty, weak):
    digest = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else F.md5  # a weak hash makes unlike texts collide
    got = exact_dedup.exact_dedup(docs, digest).collect()
    group = collections.defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        group[t].append(i)
    assert len(got) == len(texts)
    for r in got:
        g = group[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
    assert exact_dedup.exact_dedup(empty).count() == 0
    odd = docs.select("doc_id", "text").where("doc_id < 6").unionByName(docs.sparkSession.createDataFrame([(None, texts[4]), (None, "alone"), (4, texts[4])], "doc_id long, text string"))
    told = sorted(((-1 if x.doc_id is None else x.doc_id), x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(odd, digest).where("keep_id IS NOT NULL").collect())
    assert (-1, 4, 4, False) in told and told.count((4, 4, 4, True)) == 2 and exact_dedup.exact_dedup(odd, digest).count() == 9


def brute_windows(rows, n):
    """(doc_id, text) -> words and words that go, by rows."""
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < i:
                gone.update(range(a, a + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("shard", [1, 512])
def test_substring_dedup(spark, docs, texts, empty, shard):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, 12, shard, part=50).collect())
    assert got == [x[:4] for x in brute_windows(list(enumerate(texts)), 12)]
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("shard", [2, 512])
def test_substring_dedup_repeats_and_long_texts(spark, shard):
    """Repeated rows, a doc_id with two texts, a long text that holds others, and a passage that all share."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(30)
    rows = [(i, f"{text(r.randrange(40))} {passage} {text(r.randrange(40))}") for i in range(1, 25)]
    long = " ".join(t for _, t in rows[:12]) + " " + text(20000)
    rows += [(3, rows[2][1])] * 3 + [(5, text(30)), (5, rows[7][1]), (40, long), (41, long), (42, text(5) + " " + long), (43, passage), (44, None), (44, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_windows(rows, 12)
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.substring_dedup(d, 12, shard, part=400).collect()) == [x[:4] for x in want]
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.strip(d, 12, shard).collect()) == sorted((*x[:3], x[4]) for x in want)


@pytest.mark.parametrize("seed", range(12))
def test_fm_index(seed):
    """Matching statistics of texts that are not in the index, against a dictionary of its windows."""
    r = np.random.default_rng(seed)
    depth, letters = int(r.integers(2, 14)), int(r.integers(2, 30))
    base = r.integers(0, letters, 400).astype(np.uint64)

    def some(k):
        out = []
        for _ in range(k):
            n, a = int(r.integers(0, 60)), int(r.integers(0, 340))
            x = base[a : a + n].copy()
            if n and r.random() < 0.5:
                x[r.integers(0, n)] = r.integers(0, letters + 3)
            out.append(x)
        return out

    t, q, ids, least = some(30), some(30), r.permutation(30), {}
    for x, d in zip(t, ids):
        for i in range(len(x) - depth + 1):
            w = tuple(x[i : i + depth])
            least[w] = min(least.get(w, 99), d)
    got = Index(np.concatenate(t), np.array([len(x) for x in t]), ids, depth).statistics(np.concatenate(q), np.array([len(x) for x in q]))
    assert got.tolist() == [least.get(tuple(x[i : i + depth]), -1) for x in q for i in range(len(x) - depth + 1)]


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [[j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    label = [i for i, _ in rows]
    for _ in sets:
        label = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(sets))]
    return [(rows[i][0], label[i], len(links[i])) for i in range(len(sets))]


def test_jaccard_join(docs, texts, empty):
    for block in (2, 512):
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs, block=block).collect())
        assert got == sorted(brute_links(list(enumerate(texts))))
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.keep_first(empty).count() == 0


@pytest.mark.parametrize("weight", [200, 1 << 18])
def test_jaccard_join_of_a_large_group(spark, monkeypatch, weight):
    """Many near copies of one text, near and less near, with copies, repeated rows, two texts of one doc_id and a null doc_id: the pivot and the core are taken, and nothing is lost."""
    monkeypatch.setattr(jaccard_join, "WEIGHT", weight)
    r = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            t[r.randrange(len(t))] = f"n{r.randrange(1000)}"
        rows.append((1000 - i, " ".join(t)))
    rows += [(5, "some other text of its own that is not short")] * 3 + [(7, rows[0][1]), (7, "quite another text of one more kind here"), (8, "quite another text of one more kind here")]
    d = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in jaccard_join.jaccard_join(d, block=16).collect())
    want = brute_links(rows)
    assert got == sorted(want)
    kept = jaccard_join.keep_first(d.withColumn("rep", F.lit(1)).withColumn("t", F.lit(2))).collect()
    first = {r for r, (i, c, _) in zip(rows, want) if i == c}
    assert sorted((x.doc_id, x.text, x.rep, x.t) for x in kept if x.doc_id is not None) == sorted((*r, 1, 2) for r in first) and len(kept) == len(first) + 1


def test_pruning_keeps_alike_pairs():
    least = jaccard_join.least_matches(0.8)
    assert least == sorted(least) and least[-1] < 0.8 * jaccard_join.HASHES


def plain_patience(a, b, i=0, j=0):
    """Patience diff as it is described, step by step."""
    if a and b and a[0] == b[0]:
        return [(i, j), *plain_patience(a[1:], b[1:], i + 1, j + 1)]
    if a and b and a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    both = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best: list = []
    for n in range(len(both), 0, -1):  # all runs of common unique lines, longest first
        runs = [c for c in itertools.combinations(both, n) if all(x[1] < y[1] for x, y in zip(c, c[1:]))]
        if runs:
            best = runs
            break
    if not best:
        return []
    out = []
    for c in best:  # any longest run may be taken
        run, p, q = [], 0, 0
        for x, y in [*c, (len(a), len(b))]:
            run += plain_patience(a[p:x], b[q:y], i + p, j + q)
            if x < len(a):
                run.append((i + x, j + y))
            p, q = x + 1, y + 1
        out.append(run)
    return out[0] if len(out) == 1 else max(out, key=len)


def test_patience():
    a, b = [1, 2, 3, 4, 5, 9], [7, 2, 3, 8, 5, 9]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    r = random.Random(5)
    for _ in range(400):
        a, b = ([r.randrange(8) for _ in range(r.randrange(9))] for _ in range(2))
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    for _ in range(200):  # unique lines in one order: one answer
        a, b = (sorted(r.sample(range(12), r.randrange(8))) for _ in range(2))
        assert line_dedup.patience(a, b) == plain_patience(a, b) == [(a.index(x), b.index(x)) for x in a if x in b]


def cut_texts(spark, rows):
    """doc_id -> (n_lines, n_removed, text left), by both forms of the operator."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    left = {r.doc_id: r.text for r in line_dedup.delete_blocks(d).collect()}
    for i, r in told.items():
        assert r.kept_sha256 == hashlib.sha256((left.get(i) or "").encode()).hexdigest(), i
    return {i: (r.n_lines, r.n_removed, left.get(i)) for i, r in told.items()}


def test_line_dedup(spark, empty):
    rows = [(1, "alpha line number one\nbeta line number two\n\ntail a"), (2, "own start\nalpha line number one\nbeta line number two\n\nown end"), (3, "alpha line number one\nbeta line number two\n\ntail a"), (4, None), (5, ""), (6, "no\nno")]
    got = cut_texts(spark, rows)
    assert got[1][1] == 0 and got[2] == (5, 3, "own start\nown end") and got[3] == (4, 4, None) and got[4] == (0, 0, None) and got[5] == (1, 0, "") and got[6][1] == 0
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.delete_blocks(empty).count() == 0
    kept = line_dedup.delete_blocks(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int"))
    assert kept.columns == ["doc_id", "text", "row"] and {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6}


@pytest.mark.parametrize("hot", [2, 2048])
def test_line_dedup_against_all_pairs(spark, monkeypatch, hot):
    """Texts of passages in one order: a line stays in the first text alone that has it, whichever others share it."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "DEAL", hot)
    r = random.Random(11)
    lines = [f"line {k} of the common stock of lines" for k in range(60)]
    rows = []
    for i in range(80):
        t = []
        for k in range(0, 60, 5):
            if r.random() < 0.3:
                t += lines[k : k + r.randrange(1, 6)]
            if r.random() < 0.3:
                t.append(f"own line {i} {k} {r.random()}")
        rows.append((i, "\n".join(t)))
    rows[33] = (33, rows[32][1])
    rows.append((100, "\n".join([*lines, *(f"own long text line {k}" for k in range(20000))])))
    want, before = {}, []
    for i, t in rows:
        kept = [] if t in [x for _, x in before] else [x for x in t.split("\n") if x == "" or not any(x in y.split("\n") for _, y in before)]
        want[i] = "\n".join(kept)
        before.append((i, t))
    got = {i: (x[2] or "") for i, x in cut_texts(spark, rows).items()}
    assert got == want


def test_line_dedup_repeated_rows(spark):
    """Rows that repeat a doc_id and its text get one answer; another text of the doc_id is another document."""
    t = "a line that is long enough\nand one more of the kind\nend"
    rows = [(1, t), (1, t), (2, f"own\n{t}\nown"), (2, f"own\n{t}\nown"), (3, t), (1, "something quite different here\nand one more of the kind")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x for x in got if x[0] != 1] == [(2, 5, 3), (2, 5, 3), (3, 3, 3)] and sorted(x[2] for x in got if x[0] == 1) in ([0, 0, 1], [0, 1, 1])


def test_line_dedup_settles_every_shared_seed(spark):
    """However many documents share a line, and also where the first holder can't be aligned, the later ones lose it."""
    L, M = "the shared line of all", "another shared line here"
    rows = [(1, f"{L}\nmiddle of one\n{L}"), (2, f"own two a\n{L}\nown two b"), (3, f"own three a\n{L}\nown three b")]
    rows += [(11, f"{M} 2\nx of eleven\n{M} 1"), (12, f"twelve a\n{M} 1\n{M} 2\ntwelve b"), (13, f"thirteen a\n{M} 1\n{M} 2\nthirteen b")]
    rows += [(21, "21 own line that is long\noh no\nwe go\nnow on\n21 own end of the text"), (22, "22 own line that is long\noh no\nwe go\nnow on\n22 own end of the text")]
    got = {i: x[2] for i, x in cut_texts(spark, rows).items()}
    assert got[1] == rows[0][1] and got[2] == "own two a\nown two b" and got[3] == "own three a\nown three b"
    assert got[11] == rows[3][1] and got[12] == "twelve a\ntwelve b" and got[13] == "thirteen a\nthirteen b"
    assert got[21] == rows[6][1] and got[22] == "22 own line that is long\n22 own end of the text"
    many = spark.range(10_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("own line of text "), "id", F.lit(f"\n{L}\nown last line "), "id").alias("text"))
    assert [r.doc_id for r in line_dedup.line_dedup(many).where("n_removed <> 1").collect()] == [0]


def test_line_dedup_random(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    monkeypatch.setattr(line_dedup, "DEAL", 2)
    r = random.Random(9)
    rows = [(i, "\n".join(r.choice([f"shared line number {r.randrange(9)}", f"own line {i} {r.random()}", "", "ab"]) for _ in range(r.randrange(1, 12)))) for i in range(60)]
    got = {i: x[2] or "" for i, x in cut_texts(spark, rows).items()}
    for k in range(9):
        line = f"shared line number {k}"
        held, kept = ([i for i, t in z if line in t.split("\n")] for z in (rows, sorted(got.items())))
        assert kept == held[:1]
    assert all(x in got[i].split("\n") for i, t in rows for x in t.split("\n") if x.startswith("own"))


def test_line_dedup_leaves_no_shared_line(spark):
    """On the supplied corpus: of all places of lines of 12 bytes or more that an earlier document holds, none stays, and no line is lost to all."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r.text is not None)
    left = {r.doc_id: r.text for r in line_dedup.delete_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    size = lambda x: len(re.sub(rb"[\x20\x09-\x0D]", b"", x.encode()))
    seen, shared, stayed = set(), 0, 0
    for i, t in rows:
        own = [x for x in t.split("\n") if size(x) >= line_dedup.MIN_BYTES]
        kept = collections.Counter((left.get(i) or "").split("\n"))
        for x in set(own):
            if x in seen:
                shared, stayed = shared + 1, stayed + (kept[x] > 0)
            else:
                assert kept[x] == own.count(x), (i, x)
        seen.update(own)
    assert shared > 500 and stayed == 0, (shared, stayed)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_decontamination(spark, docs, texts, empty, most_bytes):
    """Both plans, all lengths of window, against a search of every place."""
    more = [(100, "Wörter, w3 W4: und x; " * 3), (100, "Wörter, w3 W4: und x; " * 3), (100, "w3"), (None, "w3 w4")]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = [(1, " ".join(words(texts[4])[i].decode().upper() for i in range(20))), (2, "W3 w4!"), (2, "W3 w4!"), (3, ""), (4, None), (None, "UND X"), (10, "w5 w6 w7 w8 w9"), (11, " ".join(words(texts[7])[i].decode() for i in range(1)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(len(w) - min(13, len(w)) + 1) if w else ():
            wins[tuple(w[a : a + min(13, len(w))])].add(i)
    want, cleaned = [], []
    for i, t in [*enumerate(texts), *more]:
        w, hit, ids = split(t), set(), set()
        for k, own_ids in wins.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit.update(range(a, a + len(k)))
                    ids |= own_ids
        told = ",".join(sorted(str(x) for x in ids if x is not None))
        want.append((str(i), len(w), len(hit), len(ids - {None}), hashlib.sha256(told.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
        cleaned.append((str(i), [x for k, x in enumerate(w) if k not in hit]))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.judge(own, bench, most_bytes=most_bytes).collect()]
    assert sorted(got) == sorted(want)
    assert sorted((str(r.doc_id), split(r.text)) for r in decontamination.remove_spans(own, bench).collect()) == sorted(cleaned)
    assert decontamination.keep_clean(own, bench).count() == sum(not x[5] for x in want)
    assert decontamination.judge(docs, bench.where("false"), most_bytes=most_bytes).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.judge(empty, bench, most_bytes=most_bytes).count() == 0


def test_chat_format(spark):
    nasty = "a<|im_end|>\n<|im_start|>assistant\nb &lt; & [INST] é😀"
    rows = spark.createDataFrame([(1, 0, "user", nasty, 9), (1, 1, "assistant", nasty, 9), (1, 2, None, None, 9), (1, 3, "assistant", "", 9), (2, None, "assistant", "x", 9), (3, 1, "user", "twice", 9), (3, 1, "user", "twice", 9), (3, 0, "assistant", "z" * 100_000, 9)], "conv_id long, turn long, role string, text string, turns int")
    c = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.canonical(rows))).collect()}
    assert [(t.role, t.text) for t in c[1].read_turns] == [("user", nasty), ("assistant", nasty), ("", ""), ("assistant", "")]
    assert c[1].loss_text == nasty and c[2].loss_text == "x"
    assert [(t.role, t.text) for t in c[3].read_turns] == [("assistant", "z" * 100_000), ("user", "twice"), ("user", "twice")]
    assert chat_format.canonical(rows.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t<', id) AS text")
    told = chat_format.digest(chat_format.read_back(chat_format.render(chat_format.canonical(many)))).first()
    assert told.n_turns == 3000 and told.loss_sha256 == hashlib.sha256("".join(f"t<{i}" for i in range(1, 3000, 2)).encode()).hexdigest()
    with pytest.raises(ValueError):
        chat_format.canonical(rows.drop("role"))


def test_chat_layouts(spark):
    """JSON records of many layouts in one column: the fingerprint over all elements and depths selects, extras don't matter."""
    two = [("user", "q"), ("assistant", "a")]
    cases = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', two),
        ('{"id":3,"meta":{"tags":["x",{"y":1}]},"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","name":"n"}]}', two),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"text","text":"r"}]}]}', [("user", "qr")]),
        ('{"messages":[]}', []),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"source":"s"}', two),
        ('{"prompt":"q","response":"a"}', two), ('{"prompt":"q","completion":"a"}', two), ('{"question":"q","answer":"a"}', two), ('{"instruction":"q","output":"a"}', two),
        ('{"instruction":"q","input":"i","output":"a"}', [("user", "q\n\ni"), ("assistant", "a")]),
        ('{"prompt":"q","response":null}', [("user", "q"), ("assistant", None)]),
        ('{"x":1}', None), ('{"prompt":"q"}', None), ("not json", None), (None, None), ("[1]", None),
    ]
    d = spark.createDataFrame([(i, j, "own") for i, (j, _) in enumerate(cases)], "i int, record string, r string")
    got = sorted(chat_format.canonical_json(d).collect())
    assert [[(t.role, t.text) for t in x.turns] if x.turns is not None else None for x in got] == [w for _, w in cases] and {x.r for x in got} == {"own"}
    kind = spark.createDataFrame([], "a struct<b int, c array<struct<d int, e array<string>>>>, f string").schema
    paths = chat_format.field_paths(kind)
    row = spark.createDataFrame([('{"f":"x","a":{"c":[{"d":1},{"e":["y"]}],"b":2}}',)], "j string")
    assert sorted(row.select(chat_format.record_paths(F.col("j"))).first()[0]) == sorted(paths) == ["a.b", "a.c[].d", "a.c[].e[]", "f"]
    typed = spark.createDataFrame([([("user", "q")], 1)], "messages array<struct<role string, content string>>, turns int")
    assert chat_format.canonical(typed).first().turns[0].text == "q"


def test_toxicity(spark, empty):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        t = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(10, 60))]
        if i % 4 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["vilest", "vilely", "VILEness"]))
        rows.append((i, " ".join(t), 1))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, 1), (901, "", 1), (902, None, 1)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.detect(d, l).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 50 and all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[900].score <= 1
    assert toxicity.keep_clean(d, l).count() == 303
    assert toxicity.detect(empty, l).count() == 0 and toxicity.detect(d, l.where("false")).agg(F.max("score")).first()[0] == 0


def test_toxicity_repeats_and_long_texts(spark):
    """A doc_id counts once in fitting however often its rows are repeated; a very long text is scored whole."""
    rows = [(i, ("plain words here " * 9) + (f"vilest vilely {i} vilest" if i % 3 == 0 else f"other things {i}")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    long = [(900, "plain words here " * 30000), (901, "plain words here " * 30000 + "vilest vilely vilest vilely vilest vilest")]
    once = {r.doc_id: r.score for r in toxicity.detect(spark.createDataFrame(rows + long, "doc_id long, text string"), labels).collect()}
    again = toxicity.detect(spark.createDataFrame(rows + long + rows[:1] * 50, "doc_id long, text string"), labels).collect()
    assert len(again) == 352 and all(abs(once[r.doc_id] - r.score) < 1e-9 for r in again)
    assert once[900] < 0.3 < once[901]


def brute_segments(x, a, b):
    """The segment of the greatest sum, and those left and right of it."""
    best = max(((sum(x[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    return [*brute_segments(x, a, best[2]), (best[2], best[3], best[0]), *brute_segments(x, best[3], b)]


def test_segments():
    got = toxicity.segments(np.array([2, 3, 10]), np.array([2.0, 3.0, 1.0]))
    assert got == [(2, 4, 5.0), (10, 11, 1.0)]
    assert toxicity.segments(np.array([0, 2]), np.array([5.0, 5.0])) == [(0, 3, 9.5)]
    r = np.random.default_rng(3)
    for _ in range(150):
        n = int(r.integers(1, 16))
        at = np.flatnonzero(r.random(n) < 0.5)
        x = np.full(n, -0.5)
        x[at] = r.random(len(at)) * 3
        got = toxicity.segments(at, x[at])
        want = brute_segments(list(x), 0, n)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    began = time.time()
    toxicity.segments(np.arange(0, 10_000_000, 100), np.ones(100_000))
    assert time.time() - began < 1


def test_lm_base(spark, docs, texts, empty):
    got = {r.doc_id: r for r in lm_scoring.score(docs, words=16, wide=24).collect()}  # a small table: most words go through the join
    whole = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    toks = {i: [w.decode().lower() for w in words(t)] + [None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, t in toks.items() if not got[i].held_out for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        for r in (got[i], whole[i]):
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.train_tokens == n
    assert lm_scoring.score(empty).count() == 0
    none = lm_scoring.score(docs, fitted=lm_scoring.fit(docs.where("false"))).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in none)


@pytest.mark.parametrize(("top", "wide"), [(20, 25), (5000, 6000)])
def test_lm_score_is_the_models_own(spark, top, wide):
    """Scores against a direct evaluation, token by token; probabilities of all words and of the unknown one sum to 1."""
    r = random.Random(2)
    vocab = [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(vocab[min(59, int(r.expovariate(0.1)))] for _ in range(r.randrange(30)))) for i in range(120)]
    rows += [(500, "never seen words x1 x2"), (501, None), (501, None), (7, rows[7][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = lm_scoring.fit(d.where("doc_id < 100"), top, wide)
    got = collections.defaultdict(list)
    for x in lm_scoring.score(d, fitted=fitted).collect():
        got[x.doc_id].append(x.score)
    counts = collections.Counter()
    hashes = {}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, _ = lm_scoring.tokens(data, np.array([0, len(data)]))
        hashes[i] = h
        if i < 100:
            counts.update(h.tolist())
    k, tree, model = fitted.counts, fitted.tree, fitted.model
    rank = dict(zip(k.wide.tolist(), k.ranks.tolist()))
    disc = k.discount

    def softmax(h, level, a, b):
        s = np.exp(model.V[level][a:b].astype(float) @ h + tree.bias[level][a:b])
        return s / s.sum()

    def probability(context, w):
        h = sum(model.C[j].astype(float) * model.R[context[j]] for j in range(3))
        one = softmax(h, 0, 0, len(tree.bias[0]))[w // 2048]
        two = softmax(h, 1, w // 2048 * 32, w // 2048 * 32 + 32)[w // 64 % 32]
        return one * two * softmax(h, 2, w // 64 * 64, w // 64 * 64 + 64)[w % 64]

    for i, h in hashes.items():
        ids, want = [rank.get(x, 0) for x in h.tolist()], 0.0
        for at, x in enumerate(h.tolist()):
            context = [ids[at - j] if at >= j else tree.words for j in (1, 2, 3)]
            if not counts[x]:
                want += np.log10(k.unknown)
                continue
            p = (1 - k.unknown) * probability(context, ids[at])
            want += np.log10(p * (counts[x] - disc) / k.rest if ids[at] == 0 else p)
        assert all(abs(s - want) < 1e-3 * max(1, abs(want)) for s in got[i]), i
    assert len(got[501]) == 2 and len(got[7]) == 2
    context = [3, tree.words, tree.words]
    of_rest = sum((c - disc) / k.rest for x, c in counts.items() if rank.get(x, 0) == 0)
    known = sum(probability(context, w) * (of_rest if w == 0 else 1) for w in range(int(max(k.ranks)) + 1) if tree.share[w] > 0)
    assert abs((1 - k.unknown) * known + k.unknown - 1) < 1e-6


def test_lm_learns(spark):
    """Words that follow each other gain over their share, by their place too."""
    r = random.Random(6)
    rows = [(i, " ".join(x for _ in range(20) for x in r.choice(["a b c", "d e f", "g h i"]).split())) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = lm_scoring.fit(d)
    good, bad = (lm_scoring.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), fitted=fitted).first().score for t in ("a b c d e f g h i", "b a i c f d h e g"))
    assert good > bad + 1


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(t):
    """(start, place of the kind, end, kind, value), by the plain patterns."""
    out = []
    for o, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0 if kind == "card" else True
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), o, m.end(), kind, m.group()))
    return sorted(out)


def plain_terms(rows, min_texts=3, min_share=0.5, min_bits=6.0):
    """Terms that disclose an entity, from the definition, over rows (doc_id, text)."""
    runs = lambda t: [(m.start(), m.end(), m.group()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t)]
    base = [plain_spans(t or "") for _, t in rows]
    apart = [[x for x in runs(t or "") if not any(s[0] < x[1] and x[0] < s[2] for s in b)] for (_, t), b in zip(rows, base)]
    entity, near, df = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for i, (_, t) in enumerate(rows):
        df.update({x[2].lower() for x in runs(t or "")})
        for s in base[i]:
            entity[s[3], s[4]].add(i)
    for e, held in entity.items():
        for i in held:
            for x in {x[2].lower() for x in apart[i]}:
                near[x, e].add(i)
    terms = set()
    for (x, e), both in near.items():
        share = len(both) / df[x]
        if len({rows[i][1] for i in entity[e]}) >= min_texts and len({rows[i][1] for i in both}) >= min_texts and share >= min_share and np.log2(share / (len(entity[e]) / len(rows))) >= min_bits:
            terms.add(x)
    out = []
    for i, (d, _) in enumerate(rows):
        every = sorted([s[:4] for s in base[i]] + [(a, 4, b, "term") for a, b, w in apart[i] if w.lower() in terms])
        out.append((d, ",".join(f"{k}:{a}:{b}" for a, _, b, k in every)))
    return terms, out


def test_pii_base_spans_against_plain_patterns(spark):
    r = random.Random(13)
    letters = "ab@.-+() 0123456789%_ é\n"
    rows = [(i, "".join(r.choice(letters if i % 2 else "0123456789.-+ ()@a") for _ in range(r.randrange(60)))) for i in range(3000)]
    rows += [(5000 + i, t) for i, (t,) in enumerate(__import__("pyarrow.parquet").parquet.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pandas().values.tolist())]
    got = {x.doc_id: [(s.start, s.o, s.end, s.kind, s.value) for s in x.spans] for x in pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_pii_terms_against_the_definition(spark):
    r = random.Random(17)
    names = [f"name{i}" for i in range(12)]
    rows = [(1000 + i, f"plain letter number {r.randrange(99)} of the day {r.choice(['', 'Name1', 'name2 name3'])} wrote") for i in range(500)]
    for i in range(80):
        k = r.randrange(4)
        rows.append((i, f"x{r.randrange(9)} {names[k * 3].title()} wrote {r.choice(names)} {'to' if r.random() < 0.5 else 'é'} box{k}@mail.org or +49 30 12345{k}{k} {r.randrange(5)}"))
    rows += [rows[-1]] * 2 + [(3000, rows[-1][1]), (3001, None), (3001, None), (3001, "Name3 name6"), (3002, "")]
    terms, want = plain_terms(rows, min_bits=3.0)
    d = spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, spans int, k string").repartition(4)
    assert len(terms) >= 4 and sorted((x.doc_id, x.spans) for x in pii.told(pii.find(d, min_bits=3.0)).collect()) == sorted(want)
    assert pii.sanitise(d).count() == len(rows)


def test_pii_is_linear(spark):
    """Very many matches and words in one text."""
    many = "a@b.cd " * 20000 + "x " * 20000
    d = spark.createDataFrame([(1, many)] + [(i, f"plain {i}") for i in range(2, 300)], "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: x.n_email for x in pii.told(pii.find(d)).collect()}
    assert got[1] == 20000 and time.time() - began < 60


def test_pii(spark, empty):
    rows = [(1, "mail a.b@c.de_x@y.com, ip 1.2.3.4.5 and 300.1.1.1"), (2, "card 4111 1111 1111 1111 not 4111 1111 1111 1112 é +1 (555) 123-4567"), (3, None), (4, ""), (5, "1" * 20000), (6, "a" * 20000)]
    rows += [(10 + i, f"unique{chr(97 + i)} zzsecretname wrote q@z.org today{i}") for i in range(5)] + [(30 + i, f"plain words today wrote {i}") for i in range(400)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, terms int")
    got = {r.doc_id: r for r in pii.told(pii.find(d)).collect()}
    assert got[1].spans == "email:5:13,email:13:21,ip:26:33"
    assert (got[2].n_card, got[2].n_phone) == (1, 1) and got[2].spans.startswith("card:5:24,")
    assert got[3].spans == got[4].spans == got[5].spans == got[6].spans == ""
    assert "term:8:20" in got[10].spans and "email" in got[10].spans and got[30].spans == ""
    safe = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "zzsecretname" not in safe[10] and "[EMAIL]" in safe[10] and safe[30] == rows[11][1] and safe[3] is None
    assert pii.find(empty).count() == 0


def test_pii_terms_go_from_every_document(spark):
    rows = [(i, f"letter {chr(97 + i)} zzsecretname wrote q@z.org") for i in range(5)] + [(5, "Here ZZsecretname has no address"), (6, None)] + [(30 + i, f"a plain letter wrote {i}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.told(pii.find(d)).collect()}[5] == "term:5:17"
    safe = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert safe[5] == "Here  has no address" and safe[6] is None and safe[30] == rows[7][1]


def test_pii_terms_of_any_length_anywhere(spark):
    """A short name and a number that stand far from the entity disclose it."""
    far = " ".join(["a plain letter wrote"] * 40)
    rows = [(i, f"{chr(97 + i)}z Li of 77b {far} q@z.org") for i in range(5)] + [(30 + i, f"a plain letter of wrote {i}") for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.told(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [s for s in got[0].split(",") if s.startswith("term")] == ["term:3:5", "term:9:12"] and got[30] == ""
    table = spark.createDataFrame([("ab a@b.cd +49 30 1234567 z",)], "text string").selectExpr("0L AS doc_id", "text")
    found = pii.base_spans(table).select(pii._apart(pii._matches(F.col("text"), pii.TERM), F.col("spans")).alias("w")).first().w
    assert [(x.start, x.end, x.value) for x in found] == [(0, 2, "ab"), (25, 26, "z")]


def test_pii_many_unlike_entities(spark):
    """Lists of thousands of unlike entities and terms in a few documents: sets of documents meet, not entities and terms."""
    n = 5000
    line = " ".join(f"u{i}x@a{i}.org name{i}" for i in range(n))
    some = " ".join(f"v{i}x@b{i}.org part{i}" for i in range(0, n, 2))
    rows = [(k, f"{line} {some if k % 2 else ''} words {k}") for k in range(6)] + [(10 + k, f"plain words number {k} here") for k in range(700)]
    rows += [(2000 + k, f"{some} here {k}") for k in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    d.count()
    began = time.time()
    got = {r.doc_id: (r.n_email, r.spans.count("term:")) for r in pii.told(pii.find(d)).collect()}
    took = time.time() - began
    assert [got[k] for k in range(6)] == [(n + (n // 2 if k % 2 else 0), n + (n // 2 if k % 2 else 0)) for k in range(6)]
    assert got[2000] == got[2001] == (n // 2, n // 2) and got[10] == (0, 0)
    assert took < 90, took


def test_lm_batches_of_any_length(monkeypatch):
    """The last batch of some texts may have one or two tokens, fewer than there are places of context; what each moved is counted."""
    from lodestone.llm import _lbl

    tree = _lbl.Tree.of(np.arange(1.0, 40.0)[::-1])
    for n in range(1, 7):
        own = _lbl.Trainer(tree, _lbl.Model.new(tree))
        own.texts(np.arange(1, n + 1), np.array([0, n]))
        assert own.seen[1][1 : n + 1].tolist() == [max(1, min(_lbl.PLACES, n - i)) for i in range(1, n + 1)]
        assert own.seen[1][tree.words] == sum(max(0, _lbl.PLACES - i) for i in range(n)) and own.seen[4][1 : n + 1].all()
        assert all(np.isfinite(a).all() for a in own.model.arrays())
    monkeypatch.setattr(_lbl, "BATCH", 8)
    for n in range(9, 13):
        own = _lbl.Trainer(tree, _lbl.Model.new(tree))
        own.texts(np.arange(n) % 30, np.array([0, 5, n]))
        assert own.seen[4].sum() >= n
