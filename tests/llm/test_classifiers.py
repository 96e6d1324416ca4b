"""Classifiers: held-out accuracy, gradients, edge rows."""

import binascii

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality, toxicity
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def is_held(i):
    return binascii.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.95), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF).collect()
    want = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([p == w for p, w in held]) >= least


def test_attention_gradients():
    rng = np.random.default_rng(1)
    model = quality.AttentionModel(5, 4, 3)
    x, bag, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, bag)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = model.gradients(model.forward(x, bag), y, bag)
    for name, grad in grads.items():
        flat, at = model.p[name].reshape(-1), 0
        for at in range(0, flat.size, max(1, flat.size // 4)):
            was = flat[at]
            flat[at] = was + 1e-6
            up = loss()
            flat[at] = was - 1e-6
            down = loss()
            flat[at] = was
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def edge(spark):
    rows = [(1, "fine words here."), (2, None), (3, ""), (None, "no id"), (4, "x " * 30_000), (1, "fine words here."), (5, "...")]
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module):
    docs, labels = edge(spark)
    got = module.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "2", "3", "4", "5", "None"])
    assert all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.doc_id in (2, 3)]
    assert empty[0] == empty[1]
    assert module.classify(docs.limit(0), labels).count() == 0
    assert module.classify(docs, labels.limit(0)).count() == 7


def test_sentences_and_location():
    model = toxicity.NoisyOr(["vile"])
    model.w, model.bias = np.array([12.0]), -6.0
    score, places = toxicity._judge(model, pa.array(["All fine. You are vile! Bye now", "All fine.", None, "vile " * 130]))
    assert score[0] > 0.9 and score[1] < 0.05 and score[2] == 0
    assert places.to_pylist() == [[2], [], [], [0, 64, 128]]


def test_noisy_or_learns_the_word_from_documents():
    rng = np.random.default_rng(3)
    label = np.arange(200) % 2
    at = [np.sort(rng.integers(0, 10, 3)) for _ in label]
    feature = [np.array([0 if y else 1, 2, 3]) if i % 5 else np.array([1, 2, 3]) for i, y in enumerate(label)]
    model = toxicity.NoisyOr(["bad", "a", "b", "c"]).fit(label, np.full(200, 10), at, feature)
    assert model.w[0] > 2 and model.w[0] > 3 * model.w[1:].max()


def test_without_toxic_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in toxicity.classify(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_every_telling_feature_is_kept(spark):
    letters = "bcdfghklmnprstvwz"
    marks = [f"{a}{b}o{c}a" for a in letters for b in letters for c in "xqj"][:700]
    rows = [(i, "plain words here " + " ".join(marks[(i * 8 + k) % 700] for k in range(8))) for i in range(2100)]
    rows += [(10_000 + i, "plain words here and there") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("toxic"))
    assert set(marks) <= set(toxicity.train(docs, labels).names)


def test_every_passage_is_fitted():
    text = " ".join(f"w{i}" for i in range(64 * 70))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int32()), pa.array([text])], names=["id", "label", "text"])
    (out,) = quality._bags(iter([batch]))
    assert len(out.column("x")[0]) == 70 * quality.WIDTH
