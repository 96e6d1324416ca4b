"""Near duplicates by MinHash and sequential verification against brute force."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import neardup as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, same = rows[b][0], len(s[a] & s[b])
            if i is not None and j is not None and same and 100 * same >= 85 * len(s[a] | s[b]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted([(i, len(x), None if i is None else find(i), None if i is None else find(i) == i) for (i, _), x in zip(rows, s, strict=True)], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "a", "b") for i, t in rows], "doc_id long, text string, n long, nid long, hub string, key string")
    return sorted(map(tuple, D.near_duplicates(df).collect()), key=str)


def corpus(seed):
    """Groups of near copies around the threshold, and a passage that half of all texts share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=40)
    out = []
    for _ in range(10):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 60, 150, 300])) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append((len(out), " ".join(t) if rng.random() < 0.8 else " ".join(t).upper()))
    n = len(out)
    out += [(n, ""), (n + 1, None), (n + 2, " \n"), (None, out[0][1]), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é É"), (n + 6, "é é"),
            (3, out[-9][1]), (0, out[0][1]), (n + 7, " ".join(f"x{i}" for i in range(40_000))), (n + 8, " ".join(f"x{i}" for i in range(39_000)))]
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_large_cluster_around_the_threshold(spark, monkeypatch):
    """Members link with some others only; rounds of hubs end and blocks take the rest."""
    monkeypatch.setattr(D, "MEMBERS", 7)
    monkeypatch.setattr(D, "BLOCK_NODES", 8)
    monkeypatch.setattr(D, "SLICE", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for p in rng.sample(range(len(t)), rng.choice([0, 1, 2, 2, 3])):
            t[p] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    got = run(spark, rows)
    assert got == brute(rows) and 1 < len({r[2] for r in got}) < 80


def test_empty_table_and_no_links(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]) == [(1, 2, 1, True), (2, 2, 2, True), (3, 0, 3, True)]


def test_bounds():
    need = D.least_matches(0.85, 1e-6)
    assert len(need) == D.HASHES // D.BATCH and (np.diff(need) > 0).all()
    assert all(D.posterior(int(m), n, 0.85) >= 1e-6 > D.posterior(int(m) - 1, n, 0.85) for m, n in zip(need, range(D.BATCH, D.HASHES + 1, D.BATCH), strict=True))
    assert D.posterior(0, 0, 0.85) == pytest.approx(0.15)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    sig = D.min_hashes(np.array([0, 900, 900, 1800]), np.concatenate((both, a, both, b)))
    assert abs((sig[0] == sig[2]).mean() - 0.8) < 0.1 and not sig[1].any()
    same = D.min_hashes(np.array([0, 900]), np.concatenate((a, both)))
    assert (same[0] == sig[0]).all() and (D.band_keys(same) == D.band_keys(sig[:1])).all()


def test_batches_drop_only_what_cannot_link():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 32, (200, D.HASHES), dtype=np.uint32)
    other = sig.copy()
    for i, share in enumerate(np.repeat([0.0, 0.5, 0.85, 1.0], 50)):
        change = rng.random(D.HASHES) >= share
        other[i, change] ^= 1
    alive, far = D.compare(sig, other, D.least_matches(0.85, 1e-6), D.least_matches(0.7, 1e-6))
    assert not alive[:100].any() and alive[100:].all()
    assert far[:50].all() and not far[100:].any()


def test_units_send_no_more_rows_than_buckets(spark, monkeypatch):
    """Small buckets that share nodes meet in one unit; a long group stays in its buckets."""
    monkeypatch.setattr(D, "BLOCK_NODES", 8)
    rng = random.Random(6)
    near = [(k, x) for k in range(40) for x in rng.sample(range(100, 116), 3)]  # many buckets, few nodes
    far = [(1000 + k, x) for k in range(60) for x in (5000, 5001 + k)]  # many nodes, few in common
    left = spark.createDataFrame([(k, x, 10) for k, x in near + far], "key long, nid long, n long")
    units = {}
    for r in D._units(left).collect():
        units.setdefault(r.nid, set()).add(r.unit)
    for bucket in {k for k, _ in near + far}:
        assert set.intersection(*[units[x] for k, x in near + far if k == bucket])
    assert all(len(units[x]) == 1 for _, x in near) and len({u for _, x in near for u in units[x]}) == 1
    assert sum(len(u) for x, u in units.items() if x >= 5000) == len(far)


def test_cells_of_linked_buckets_send_nodes_few_times(spark, monkeypatch):
    sent = []

    def counted(rows, *args):
        sent.append((rows.count(), rows.select("nid").distinct().count()))
        return run_cells(rows, *args)

    run_cells = D.run_cells
    monkeypatch.setattr(D, "run_cells", counted)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        t = list(base)
        for p in rng.sample(range(len(t)), rng.choice([2, 3, 4])):
            t[p] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    assert run(spark, rows) == brute(rows)
    assert sent and all(n <= 2 * nodes for n, nodes in sent)
