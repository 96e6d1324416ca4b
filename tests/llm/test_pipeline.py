"""The pipeline's stages against brute force, one after another."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing, pii, toxicity
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in at.items() if k != "packing"}

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.classify(at["input"], labels).filter("predicted = 1").collect()}
    assert texts["toxicity"] == {i: t for i, t in texts["input"].items() if i not in bad}

    roots = {i for i, _, root, _ in brute(list(texts["toxicity"].items())) if i == root or root is None}
    kept = texts["ngram_jaccard_join"]
    assert {i for i in kept if kept[i].strip()} == {i for i in roots if texts["toxicity"][i].strip()}
    assert all(texts["toxicity"][i] == t for i, t in kept.items())

    private = texts["pii_surrogates"]
    assert set(private) == set(kept)
    for i, t in kept.items():
        found = pii.find(t)
        assert (private[i] != t) == bool(found)
        assert not any(t[a:b] in private[i] for a, b, kind, _ in found if kind not in ("domain",))
    assert at["pii_surrogates"].filter(F.col("n_chars") != F.length("text")).count() == 0

    times = Counter(r.doc_id for r in at["source_mix"].select("doc_id").collect())
    want = {r.doc_id: round(r.taken / r.size) if r.size else 1 for r in mixing.mix(at["pii_surrogates"]).collect()}
    assert times == Counter({i: n for i, n in want.items() if n})

    pieces = at["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.t * times[r.doc_id] for r in pieces}
    assert set(times) == {r.doc_id for r in pieces}
    assert not re.search("collect", str(corpus_pipeline.ORACLE_SQL))


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
