"""Vectors in blocks: packing rows for tasks that score block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_k

#: Candidates and queries of one task.
BLOCK, QUERY_BLOCK = 2048, 1024


def usable(vector: str) -> Column:
    """True for a vector without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row of each id: the smallest vector."""
    return top_k(df, [id_col], [F.col(vector).cast("string")], 1, "_once").drop("_once")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    rows = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids, best first."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.int64)
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Cells:
    """Blocks of candidates against blocks of queries, one pair per task unit."""

    def __init__(self, base: DataFrame, asked: DataFrame):
        self.parts = max(1, -(-base.count() // BLOCK))
        self.query_parts = max(1, -(-asked.count() // QUERY_BLOCK))
        self.candidates = (
            base.withColumn("cb", F.pmod(F.xxhash64("uid"), F.lit(self.parts)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(self.query_parts - 1))))
        )

    def run(self, asked: DataFrame, cell, schema: str) -> DataFrame:
        """``cell(key, queries, candidates)`` of every pair of blocks of equal dimension."""
        q = (
            asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(self.query_parts)).cast("int"))
            .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.parts - 1).cast("bigint"))))
        )
        keys = ["dim", "qb", "cb"]
        return q.groupBy(*keys).cogroup(self.candidates.groupBy(*keys)).applyInArrow(cell, schema)
