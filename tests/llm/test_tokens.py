"""Token counts and packing against the tokenizer itself."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing, tokens, words
from corpusloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "It's DON'T we'll", "W̊ x́ é. É", "ΣΑΣ İstanbul straße", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
       "a\x1cb\x1d c\x85d e　f​g", "x.  y, z. .. ,, a.b a., \n.b\t, c.\n\n", "日本語 テスト 123 4.5 ½", "!!! ### a!!b", "z" * 5000, "word " * 3000,
       "the.\nthe, the. the", " .a", "́a b́.", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


def frame(spark):
    rows = [(i, t, "s", 0) for i, t in enumerate(ODD)] + [(3, "again again", "s", 0), (3, "again again", "s", 0), (None, "no id", "s", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, uid string, length int").repartition(3)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [12 << 20, 40])
def test_counts(spark, library, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    monkeypatch.setattr(tokens, "RUN_BYTES", 8 * block)
    rows, df = frame(spark)
    got = sorted(map(str, map(tuple, tokens.token_counts(df, tokenizer(), limit=100).collect())))
    want = []
    for i, t, _, _ in rows:
        n = len(ids_of(library, t))
        want.append(str((i, len((t or "").encode()), n, n > 100)))
    assert got == sorted(want)
    assert tokens.token_counts(df.limit(0), tokenizer()).count() == 0


def check_packing(rows, texts, library, window):
    sequences, docs = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    want = Counter()
    for i, t in texts:
        ids = [*ids_of(library, t), 1]
        for lo in range(0, len(ids), window):
            part = ids[lo:lo + window]
            want[i, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    return len(sequences), sum(k[2] * n for k, n in want.items())


def test_packing_round_trip(spark, library):
    rows, df = frame(spark)
    check_packing(packing.pack(df, tokenizer(), window=64).collect(), [(i, t) for i, t, _, _ in rows], library, 64)
    assert packing.pack(df.limit(0), tokenizer()).count() == 0


def test_packing_fills_sequences(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    n, total = check_packing(packing.pack(df, tokenizer()).collect(), texts, library, 2048)
    assert total >= 0.97 * 2048 * (n - 1)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 10, 64, 100])
    pieces = [rng.randint(1, window) for _ in range(rng.randint(0, 200))]
    sequences, seen = {}, Counter()
    for length, first, last, per, sequence, place in packing.best_fit_runs(Counter(pieces), window):
        for rank in range(first, last + 1):
            nth, slot = divmod(rank - first, per)
            sequences.setdefault(sequence + nth, []).append((place + slot * length, length))
            seen[length] += 1
    assert seen == Counter(pieces)
    free = []
    for length in sorted(pieces, reverse=True):
        i = bisect.bisect_left(free, length)
        bisect.insort(free, (free.pop(i) if i < len(free) else window) - length)
    assert sorted(window - sum(n for _, n in s) for s in sequences.values()) == free


def test_words_of_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "", " c\x1c\x0bd ", "é"])], names=["text"])
    parts = list(words.blocks([batch, batch.slice(0, 0)], "text", 4))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert [t for p in parts for t in pc.ascii_lower(p.column("text")).to_pylist()] == ["a b", None, "", " c\x1c\x0bd ", "é"]
    for p in parts:
        pc.ascii_lower(p.column("text")).validate(full=True)
    w = words.split(batch.column("text"))
    assert w.offsets.tolist() == [0, 2, 2, 2, 4, 5]
    assert [w.vocabulary[i].as_py() for i in w.codes.tolist()] == ["a", "b", "c\x1c", "d", "é"]
