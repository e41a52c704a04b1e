"""Token files: exact round trips, against the tokenizers library text by text."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import _rans, token_output
from lodestone.llm._tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n ", "plain words, and more.", "It's, we'll; they're! 's 't", "86.116.193.48 +1 (415) 555-0199 a_b-c x*&y", "<|endoftext|> <|ENDOFTEXT|>, a<|startoftext|>b", "Éaiè, enäungö; FÜR Straße… ﬁ ² ½ µ ª",
    "é Å H̱ İ ΣΑΣ Ǆ ǅ", "日本語のテキスト、と漢字。 한국어", "a b c\u0085d​e \x1c \x00 \x01", "#" * 40 + " # ## !", "tab\tand\rfeed\x0b\x0c!?", "\U0001f600\U0001f468‍\U0001f469 ok\U0001f600.", "WORD Word word wOrD, WORD.", "no space.after:marks;here?ok!1a2b3c", "×÷ a×b, c÷d. Ã× Ã÷,",
]


@pytest.mark.parametrize("path", [WORDS, public_tokenizers.path("byte_bpe_50k.json")])
def test_encoder(path):
    enc, plain = Encoder(path), Tokenizer.from_file(path)
    assert enc.by_word == (path == WORDS)
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS for _ in range(3)]):
        raw = [(t or "").encode() for t in texts]
        ids, n = enc.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr("lodestone.llm._tokens.MEMO", 5)
    enc, plain = Encoder(WORDS), Tokenizer.from_file(WORDS)
    for k in range(30):
        raw = f"word{k} and some{k % 7} of them, the {k} th".encode()
        assert enc.texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == plain.encode(raw.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "kinds", "lanes", "every"), [(0, 1, 4, 2), (1, 1, 4, 2), (5000, 1, 8, 3), (7001, 300, 16, 5), (200_001, 40_000, 1024, 16)])
def test_block(n, kinds, lanes, every):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(min(1, max(2 / kinds, 0.001)), n) - 1, kinds - 1).astype(np.uint32)
    table = _rans.put_table(_rans.frequencies(np.bincount(ids, minlength=kinds)))
    freq = _rans.get_table(table)
    assert not n or int(freq.sum()) == 1 << _rans.BITS and ((freq > 0) == (np.bincount(ids, minlength=kinds) > 0)).all()
    lengths = np.array([n // 3, 0, n - n // 3])
    block = _rans.encode(table, np.array([-5, 0, 2**62]), np.array([0, 1, 0]), lengths, ids, lanes, every)
    got = _rans.decode(table, block)
    assert (got.ids == ids).all() and got.lengths.tolist() == lengths.tolist() and got.doc_ids.tolist() == [-5, 0, 2**62] and got.null.tolist() == [False, True, False]
    seen = 0
    for k in range(_rans.checkpoints(table, block)):  # in any order, each by itself
        at, some = _rans.decode_from(table, block, k)
        assert at == seen and (some == ids[at : at + len(some)]).all()
        seen += len(some)
    assert seen == n
    if n > 100:
        harmed = bytearray(block)
        harmed[-9] ^= 1
        with pytest.raises(ValueError):
            _rans.decode(table, bytes(harmed))
        with pytest.raises(ValueError):
            _rans.decode(_rans.put_table(_rans.frequencies(np.ones(kinds + 1, int))), block)
    if n > 100_000:  # near the entropy
        bits = 8 * (len(block) - 8 * lanes * (1 + n // (lanes * every))) / n
        p = np.bincount(ids) / n
        assert bits < -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.6


def brute(rows, end_id):
    plain, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


def test_files(spark, tmp_path):
    rows = [((i * 37) % 101 - 20, t) for i, t in enumerate(TEXTS * 2 + ["Long text, " * 30000])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, h int").repartition(5)
    token_output.write(docs, f"{tmp_path}/a", WORDS, 2, block=100)
    got = sorted(map(tuple, token_output.read(spark, f"{tmp_path}/a").collect()))
    assert got == brute(rows, 2)
    assert sorted(map(tuple, token_output.read(spark, f"{tmp_path}/a", ids=False).collect())) == [g[:4] for g in got]
    shards = spark.read.parquet(f"{tmp_path}/a/manifest").orderBy("shard").collect()
    assert [s.base for s in shards] == [sum(t.n_tokens for t in shards[:i]) for i in range(len(shards))] and sum(s.n_docs for s in shards) == len(rows)


def test_files_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (7, "same text"), (7, "same text"), (7, "other"), (7, None), (3, "")]
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{tmp_path}/b", WORDS, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, tuple(r.ids)) for r in token_output.read(spark, f"{tmp_path}/b").collect())
    assert sorted((str(g[1]), g[3]) for g in got) == sorted((str(b[0]), tuple(b[4])) for b in brute(rows, 2))
    assert [g[1] for g in got] == [None, None, 3, 7, 7, 7, 7] and [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(7)]


def test_empty_table(spark, tmp_path):
    token_output.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/c", WORDS, 2)
    assert token_output.read(spark, f"{tmp_path}/c").collect() == []


def test_query(spark):
    from lodestone.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_token_output(spark, sf).collect())) == [b[:4] for b in brute(rows, 2)]
