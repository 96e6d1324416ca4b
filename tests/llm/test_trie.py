"""Conversation prefix trie against a plain trie."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, turns string, depth int, node string"


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in convs.items()}


def brute(convs):
    """Rows of the result, from {conv_id: turns}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []

    def below(node):
        saved = (len(members[node]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0)
        leaves = 0 if kids[node] else 1
        for k in kids[node]:
            s, n = below(k)
            saved, leaves = saved + s, leaves + n
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if members:
        below(())
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = ["yes", "no", "tell me more", "", None, "é  ü\tö", "a b c d", "stop\n", "  "]
    rows = []
    for c in range(0, n, rng.choice([1, 2])):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "user", "user", None, ""]), rng.choice(texts[:rng.choice([2, 9])])))
    same = [(turn, "user", f"turn {turn}") for turn in range(4)]
    rows += [(c, *t) for c in range(1000, 1100) for t in same]  # one conversation many times
    rows += [(2001, turn, "user", f"long {turn}") for turn in range(90)]
    rows += [(2021, turn, "user", f"long {turn}") for turn in range(70)]
    rows += [(2040, None, "system", "null first"), (2040, 0, "user", "then this"), (None, 0, "user", "lost"), (-7, 0, "user", "below zero")]
    rng.shuffle(rows)
    return rows


def result(spark, rows, turns):
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    return sorted(map(tuple, T.prefix_trie(turns(T.conversations(df))).collect()), key=str)


@pytest.mark.parametrize("shard", [30, 300, 10**6])
def test_shards_of_any_size_give_the_same_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(T, "SHARD_TURNS", shard)
    rows = [r for r in corpus(1) if r[0] is None or r[0] >= 0]
    assert result(spark, rows, T.with_shared_heads) == brute(rebuilt(rows))


def test_copies_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TURNS", 25)
    convs = {c: [("user", "hi"), ("assistant", "hello there")] for c in range(150)} | {200: [], 201: [], 202: [("user", "hi")]}
    df = spark.createDataFrame([(c, i, *t) for c, v in convs.items() for i, t in enumerate(v)], "conv_id long, turn long, role string, text string")
    both = T.conversations(df).unionByName(spark.createDataFrame([(200, []), (201, [])], "conv_id long, turns array<binary>"))
    assert sorted(map(tuple, T.prefix_trie(both).collect()), key=str) == brute(convs)


def test_empty_table(spark):
    assert result(spark, [], T.with_shared_heads) == [] and result(spark, [(None, 0, "user", "a")], lambda d: d) == []


@pytest.mark.parametrize("columns", [1, 2, 5, 64])
def test_matrices_order_and_nodes(monkeypatch, columns):
    monkeypatch.setattr(T, "COLUMNS", columns)
    rng = random.Random(columns)
    convs = {c: tuple(rng.choice([1, 1, 2, 3]) for _ in range(rng.choice([0, 1, 2, 2, 4, 7, 12]))) for c in rng.sample(range(10_000), 300)}
    ids = np.array(list(convs))
    cut = np.concatenate(([0], np.cumsum([len(v) for v in convs.values()])))
    code = np.array([x for v in convs.values() for x in v], np.int32)
    order, nodes, last = T.ordered(ids, cut, code)
    rows = [convs[i] for i in ids[order].tolist()]
    assert list(zip(rows, ids[order].tolist(), strict=True)) == sorted((v, c) for c, v in convs.items())
    found = {(d, rows[f][:d], n, m) for d, f, n, m, _, _ in nodes.T.tolist()}
    want = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            want[v[:d]].append(c)
    assert found == {(len(k), k, len(v), min(v)) for k, v in want.items()} and len(nodes.T) == len(want)
    for d, f, _, _, p, _ in nodes.T.tolist()[1:]:
        assert nodes[0, p] == d - 1 and rows[nodes[1, p]][:d - 1] == rows[f][:d - 1]
    assert all(nodes[0, e] == len(r) and rows[nodes[1, e]][:len(r)] == r for e, r in zip(last.tolist(), rows, strict=True))
