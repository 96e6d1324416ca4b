"""Hard negatives by cover trees against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dim string, block string, id string, uid string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, c, "a", "b", "c", "d", "e") for i, v, c in rows], SCHEMA)


def brute(rows, positives=5, k=3):
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
          if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, c in ok:
        if a % 50:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, d) for i, w, d in ok if i != a and len(w) == len(v))
        for s, p, _ in [x for x in near if x[2] == c][:positives]:
            got = [(-t, i) for t, i, d in near if d != c and 50 * -s <= 100 * -t <= 95 * -s][:k]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(got, 1)]
    return sorted(out)


def table(seed=3, n=600, dim=6):
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(150, dim)).round(1)
    rows = [(i, some[rng.integers(0, 150)].tolist(), int(rng.integers(0, 4))) for i in range(n)]  # ties and copies
    rows += [(9001, None, 1), (9002, [1.0] * 5 + [None], 1), (9003, [1.0] * 5 + [math.nan], 1), (9004, [math.inf] + [1.0] * 5, 1),
             (None, some[0].tolist(), 1), (9050, some[1].tolist(), None), (9100, [0.0] * dim, 0), (9150, [0.5, 0.5], 0), (9151, [0.25, 0.75], 0),
             (9152, [0.5, 0.25], 1), (9200, [], 2), (9201, [], 2), (7, some[3].tolist(), 2), (7, some[3].tolist(), 3)]
    return rows


@pytest.mark.parametrize("block", [40, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ANCHORS", 5)
    rows = table()
    got = sorted(map(tuple, N.hard_negatives(rows_of(spark, rows)).collect()))
    assert got == brute(rows) and len(got) > 50


def test_one_label_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = [(i, v, 0 if i is not None and i % 3 else c) for i, v, c in table(5)]
    assert sorted(map(tuple, N.hard_negatives(rows_of(spark, rows)).collect())) == brute(rows)


def test_empty_tables_and_no_negatives(spark):
    assert N.hard_negatives(rows_of(spark, [])).collect() == []
    assert N.hard_negatives(rows_of(spark, [(0, [1.0], 1), (1, [1.0], 1)])).collect() == []
    assert N.hard_negatives(rows_of(spark, [(0, [1.0], 1), (1, [0.5], 2)])).collect() == []


def test_huge_and_long_vectors(spark):
    rows = [(0, [3e30, 1.0], 0), (1, [2e30, 5.0], 0), (2, [1e30, 2.0], 1), (3, [1.5e30, 2.0], 1)]
    got = N.hard_negatives(rows_of(spark, rows)).collect()  # scores are cut to a long, and so are the windows
    assert all(r.positive_score == 2**63 - 1 for r in got)
    wide = [(i, np.random.default_rng(i).normal(size=3000).round(3).tolist(), i % 3) for i in range(0, 120, 5)]
    assert sorted(map(tuple, N.hard_negatives(rows_of(spark, wide)).collect())) == brute(wide)


@pytest.mark.parametrize("shape", [(3000, 4), (400, 2), (200, 3)])
def test_radii_cover_and_bounds_save_work(shape):
    rng = np.random.default_rng(8)
    points = np.floor(256 * (rng.normal(size=shape) * 0.05 + rng.normal(size=(12, shape[1]))[rng.integers(0, 12, shape[0])]))
    order, nodes = N.build(points)
    x = N.augmented(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for n in nodes:
        assert np.sqrt(((x[order[n.start:n.stop]] - x[n.center]) ** 2).sum(axis=1)).max() <= n.radius
    for i, n in enumerate(nodes[1:], 1):
        up = nodes[n.parent]
        assert n.parent < i and up.start <= n.start < n.stop <= up.stop


def test_descent_skips_nodes(spark):
    # clustered vectors: most leaves are passed over, the answer is the same
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 8))
    points = (centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8)) * 0.03)
    df = spark.createDataFrame([(i, v.tolist(), i % 5, 0, 0, 0, 0, 0) for i, v in enumerate(points)], SCHEMA.replace("string", "int"))
    rows = df.selectExpr("vec_id as id", "cast(label as string) label", "embedding as v").toArrow()
    got = N._build_block(256)([pa.scalar(8), pa.scalar(0)], rows)
    tree = N.Tree(got)
    q, seen = tree.points[:50], []
    asks = np.arange(50)
    score, _ = N.descend(tree, q, tree.ids[:50], tree.names[tree.code[:50]], asks, np.full(50, -np.inf), np.full(50, np.inf), True, 5, seen)
    assert sum(seen) < 0.3 * 50 * 2000
    for i in range(50):
        every = q[i] @ tree.points.T
        mask = (tree.code == tree.code[i]) & (tree.ids != tree.ids[i])
        assert sorted(every[mask])[::-1][:5] == score[i].tolist()
