"""The stages of the pipeline on small tables: each against brute force on its own input, with nulls, empties, repeated rows, empty tables and clashing columns."""

import re

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gone int, k string, t int"


def words(t):
    return (t or "").split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark tables."""
    out = tmp_path_factory.mktemp("tables")
    item = " ".join(f"item{i}" for i in range(15))
    shared = "\n".join(f"a shared passage line {i} of many documents" for i in range(4))
    rows = []
    for i in range(240):
        body = " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(40))
        rows.append([i, f"{body}\nown closing line {i}"])
        if i % 4 == 0:
            rows[-1][1] += " vilest vilely vilest"
    rows += [[300, f"own opening line 300\n{shared}"], [301, f"own opening line 301\n{shared}\nown closing line of 301"]]
    near = [f"n{j}" for j in range(100)]
    rows += [[310, " ".join(near)], [311, " ".join([*near[:99], "other"])], [312, " ".join(["other", *near])]]
    rows += [[320, f"read this {item} now"], [321, "some clean text without any item words in it"]]
    rows += [[330, None], [331, ""], [None, "a text without an id"], [340, "the same row once more in the table"], [340, "the same row once more in the table"]]
    spark.createDataFrame([(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 3}", len(t or ""), "r", 1, "k", 2) for i, t in rows], SCHEMA).coalesce(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def stages(spark, folder):
    """What each stage gets and gives, as rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = [(docs.columns, docs.collect())]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        told.append((docs.columns, docs.collect()))
    return told


def test_stages(spark, folder):
    docs, clean, lines, near, decont, mix = stages(spark, folder)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "decontamination", "mixing"]
    for cols, rows in (clean, lines, near, decont):
        assert cols == docs[0] and all((r.row, r.gone, r.k, r.t) == ("r", 1, "k", 2) for r in rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, clean[1])) == sorted(key(r) for r in docs[1] if "vilest" not in (r.text or ""))
    # line dedup: what is left of each text, against a search for each line in all smaller doc_ids
    held: dict = {}
    for r in clean[1]:
        if r.doc_id is not None:
            for x in (r.text or "").split("\n"):
                held.setdefault(x, set()).add(r.doc_id)
    want = []
    for r in clean[1]:
        left = [x for x in (r.text or "").split("\n") if len(re.sub(r"\s", "", x)) < 12 or r.doc_id is None or min(held[x]) == r.doc_id]
        if left:
            want.append((r.doc_id is None, r.doc_id or 0, None if r.text is None else "\n".join(left)))
    assert sorted(want, key=str) == sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in lines[1]), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) or r.text is None for r in lines[1])
    # near copies: one of each group of links at 0.8 on shingles of five words
    sets = [({tuple(words(r.text)[i : i + 5]) for i in range(len(words(r.text)) - 4)} or ({tuple(words(r.text))} if words(r.text) else set())) for r in lines[1]]
    label = [r.doc_id for r in lines[1]]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and label[i] is not None and label[j] is not None and len(a & b) >= 0.8 * len(a | b)]
    for _ in range(5):
        for i, j in pairs:
            label[i] = min(label[i], label[j])
    stay = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r, c in zip(lines[1], label) if r.doc_id == c})
    assert sorted(map(key, near[1])) == stay and not {311, 312} & {r.doc_id for r in near[1]}
    assert sorted(map(key, decont[1])) == [k for k in stay if k[1] != 320]
    assert {(r.doc_id, r.size) for r in mix[1]} == {(r.doc_id, len(words(r.text))) for r in decont[1]} and all(0 <= r.taken <= 2 * r.size for r in mix[1])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, mix[1]))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    none = stages(spark, str(tmp_path))
    assert all(cols == none[0][0] for cols, _ in none[:-1])
    # no labels and no items: nothing is toxic or contaminated
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == docs.count() == corpus_pipeline.without_contaminated(spark, docs, str(tmp_path)).count()
