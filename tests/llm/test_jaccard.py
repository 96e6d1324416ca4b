"""N-gram Jaccard join against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import jaccard

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{(id, text): (n, component, links)} by all pairs of rows."""
    s = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            same = len(s[a] & s[b])
            if i is None or j is None or not same or 100 * same < 75 * len(s[a] | s[b]):
                continue
            links[a] += 1
            links[b] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted([(i if i is not None else -1, len(s[a]), (find(i) if i is not None else None), links[a]) for a, (i, _) in enumerate(rows)], key=str)


def corpus(seed, groups=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=30)
    out, n = [], 0
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 9, 40, 120, 400]))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 2, 6, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
            out.append((n, rng.choice([text, text.upper(), "\n" + text.replace(" ", "\t", 2) + "  "])))
            n += 1
    out += [(n, ""), (n + 1, None), (n + 2, " \n"), (None, out[0][1]), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é É"), (n + 6, "é é")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "s", "x") for i, t in rows], "doc_id long, text string, n int, uid string, block string")
    got = jaccard.jaccard_join(df.repartition(3)).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.n_links) for r in got], key=str) == brute(rows)


def test_screen_needs_hold_for_all_sizes():
    """The number of shared prefix shingles that the screen asks for is never above the least possible."""
    num, den = 75, 100
    for a in range(1, 200):
        for b in range(a, a * den // num + 1):
            common = -(-num * (a + b) // (num + den))
            for n in (a, b):  # the text whose prefix ends first
                outside = n - (jaccard.prefix_length(n, num, den) + n // jaccard.EXTRA)
                for m in (a, b):
                    assert common - outside >= 1 + -(-num * m // den) // jaccard.EXTRA


def test_one_per_group(spark):
    rows = [(4, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "other words"), (None, "a b c d e f g h"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, id string")
    got = jaccard.one_per_group(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == [-1, 2, 7, 8, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(df).count() == 0
    assert jaccard.one_per_group(df).count() == 0


def test_tokens_of_a_block_keep_their_rows():
    rng = np.random.default_rng(3)
    token, row = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 900, 5000)
    ranges, bodies = jaccard._pack(token, row)
    assert ranges == sorted(set(ranges)) and sum(map(len, bodies)) == 6 * len(token)
    codes, rows, size = jaccard._unpack(bodies)
    got = sorted(zip(np.repeat(ranges, size).tolist(), codes.tolist(), rows.tolist()))
    assert got == sorted((int(t) >> 53, int(t) >> 21 & 0xFFFFFFFF, r) for t, r in zip(token, row.tolist()))
    assert jaccard._pack(token[:0], row[:0]) == ([], [])


def test_neighbouring_rows_of_a_key_come_together():
    keys = [[1, 1, 2], [2], [], [2, 3], [4]]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64())}) for k in keys]
    assert [t.column("k").to_pylist() for t in jaccard._by(iter(batches), "k")] == [[1, 1], [2, 2, 2], [3], [4]]


def test_screen_writes_no_token_of_texts_without_partner(spark, tmp_path, monkeypatch):
    """What the steps write as tables stays far below the texts when nothing links."""
    written = []

    def kept(df):
        path = f"{tmp_path}/step{len(written)}"
        df.write.parquet(path)
        written.append(sum(f.stat().st_size for f in Path(path).glob("*.parquet")))
        return df.sparkSession.read.parquet(path)

    monkeypatch.setattr(jaccard, "settle_table", kept)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(900)], k=300))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_links for r in jaccard.jaccard_join(df).collect()} == {0}
    assert sum(written) < sum(len(t) for _, t in rows) / 4
