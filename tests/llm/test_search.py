"""Exact and approximate vector search against brute force."""

import math

import numpy as np
import pytest

from corpusloom.llm import ann, topk
from corpusloom.llm import vectors as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, score string, rank string, dim string, v string"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, v, "x", "y", "z", "w") for i, v in pairs], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_products(pairs, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in pairs if i is not None and usable(v)]
    out = []
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def small_vectors():
    rng = np.random.default_rng(2)
    some = rng.normal(size=(12, 4)).round(1).tolist()
    pairs = [(i, some[i % 12]) for i in range(0, 420, 7)]  # many equal vectors, so many ties
    return [*pairs, (1000, some[3]), (1001, None), (1002, [1.0, None, 0.0, 0.0]), (1003, [1.0, float("nan"), 0.0, 0.0]),
            (1004, [float("inf"), 0.0, 0.0, 0.0]), (1100, [0.0] * 4), (1105, [-0.0] * 4), (1200, [0.5, 0.25]), (1201, [0.5, 0.5]),
            (7, some[5]), (None, some[1])]


@pytest.mark.parametrize("segments", [1, 2, 3])
def test_top_k_equals_brute_force(spark, monkeypatch, segments):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    pairs = small_vectors()
    got = topk.top_k_inner_product(rows_of(spark, pairs), 5, segments=segments).collect()
    assert sorted(map(tuple, got)) == brute_products(pairs, 5)


def test_top_k_of_huge_components(spark):
    pairs = [(0, [1e20, 3.0]), (1, [2.0, 1.0]), (2, [1e20, 1.0]), (3, [-1e20, 1.0])]
    got = [tuple(r) for r in topk.top_k_inner_product(rows_of(spark, pairs)).collect()]
    assert [r[2] for r in sorted(got)] == [1, 2, 3]
    assert [r[3] for r in sorted(got)][0] == 2**63 - 1


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert topk.top_k_inner_product(none).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k_inner_product(none).count() == 0
    assert ann.search(none).count() == 0


def test_search_finds_all_of_a_few(spark):
    pairs = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.5]), (6, [1.0])]
    got = sorted(map(tuple, ann.search(rows_of(spark, pairs)).collect()))
    assert [(r[1], r[2]) for r in got] == [(1, 5), (2, 1), (3, 2)]
    assert got[0][3] == 0.5 and got[1][3] == math.sqrt(2)


@pytest.mark.parametrize("bucket", [4096, 64])
def test_search_recall(spark, monkeypatch, bucket):
    monkeypatch.setattr(ann, "BUCKET", bucket)
    monkeypatch.setattr(ann, "BUCKET_PROBES", bucket)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, got in found.items():
        far = sorted((math.sqrt(((data[q] - x) ** 2).sum()), i) for i, x in data.items() if i != q)
        hit += len({i for _, i in far[:10]} & {i for _, i, _ in got})
        total += 10
        got.sort()
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        for _, i, s in got:
            assert s == pytest.approx(math.sqrt(((data[q] - data[i]) ** 2).sum()), abs=1e-12)
    assert set(found) == {i for i in data if i % 100 == 0}
    assert hit >= 0.9 * total


def test_probes_come_in_order_of_success():
    inside = np.array([0.1, 0.45, 0.7])
    sets = ann.perturbations(inside, 20)
    cost = [sum((inside[c] if s < 0 else 1 - inside[c]) ** 2 for c, s in chosen) for chosen in sets]
    assert sets[0] == [] and cost == sorted(cost)
    assert len({tuple(sorted(s)) for s in sets}) == len(sets) == 20
