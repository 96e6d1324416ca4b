"""Exact top-k search by a three-phase uniform threshold.

The score is an integer inner product, summed over segments of the components.
Each block of candidates keeps one score list per segment.

1. Every list gives its k best entries per query, with the whole score of
   each; the k-th best score over all blocks is a safe lower bound.
2. That bound over the number of segments is the cutoff sent to the lists: a
   candidate that reaches the bound reaches the cutoff in some segment. The
   lists give all entries at the cutoff; those that cannot reach the bound with
   the most that the segments not seen may add are left out.
3. What is not known of the rest is computed exactly, where their vectors lie,
   and what reaches the bound is ranked.

Candidates and queries meet as blocks of bounded size, the bounds travel with
their queries. Of equal vectors in a block only the k + 1 smallest ids can
matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_k
from ..session import settle, settle_table
from . import vectors as V

LONG = 1 << 63
RESULT = "query_id long, vec_id long, score long"


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers; int64 if all products fit, else Python's."""
    v = np.floor(scale * vectors.astype(np.float64))
    most = np.abs(v).max(initial=0)
    if most * most * max(1, v.shape[1]) < 2**53:
        return v.astype(np.int64)
    return np.vectorize(int, otypes=[object])(v) if v.size else v.astype(object)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; floats hold those of small integers."""
    if q.dtype == object or c.dtype == object:
        return q.astype(object) @ c.astype(object).T
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if float(most) < 2**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(object) @ c.astype(object).T


def bounds(dim: int, segments: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(segments, max(1, dim)) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _fit_long(x) -> int:
    return max(-LONG, min(LONG - 1, int(x)))


def _folded(ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Positions without the copies of a vector beyond its k + 1 smallest ids."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(c[order].astype(np.float64), axis=0, return_inverse=True)
    by = np.argsort(same, kind="stable")
    group = same[by]
    start = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1)) if len(group) else np.zeros(0, int)
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return order[by[place <= k]]


def _cell(k: int, segments: int, scale: int, phase: int):
    """Scores of one block of candidates for one block of queries."""

    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            q = scaled(V.matrix(queries.column("v").combine_chunks()), scale)
            c = scaled(V.matrix(candidates.column("v").combine_chunks()), scale)
            ids = candidates.column("id").to_numpy()
            keep = _folded(ids, c, k)
            ids, c = ids[keep], c[keep]
            parts = [products(q[:, a:b], c[:, a:b]) for a, b in bounds(q.shape[1], segments)]
            bound = queries.column("bound").to_pylist()
            for i, query in enumerate(queries.column("id").to_pylist()):
                other = np.flatnonzero(ids != query)
                p = np.stack([x[i][other] for x in parts])
                if phase == 1:
                    best = [V.best(x, ids[other], k) for x in p]
                    hit = other[np.unique(np.concatenate(best))]
                elif bound[i] is None:  # fewer than k candidates in all
                    hit = other
                else:
                    need, m = bound[i], len(parts)
                    seen = (p * m >= need).astype(bool)
                    known, unseen = np.where(seen, p, 0).sum(axis=0), m - seen.sum(axis=0)
                    # a part that is not seen is below the cutoff
                    able = seen.any(axis=0) & (known * m + unseen * (need - 1) >= need * m).astype(bool)
                    hit = other[able]
                    hit = hit[(products(q[i:i + 1], c[hit])[0] >= need).astype(bool)]
                out += zip([query] * len(hit), ids[hit], products(q[i:i + 1], c[hit])[0], strict=True)
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array([_fit_long(x) for x in col], pa.int64()) for col in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k_inner_product(vectors: DataFrame, k: int = 10, is_query: str = "vec_id % 100 = 0", scale: int = 1024,
                        id_col: str = "vec_id", vector_col: str = "embedding", segments: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every other row's vector.

    Components count as floor(``scale`` * x). Queries are the rows for which
    ``is_query`` holds; ties go to smaller ids. Vectors that are null or hold a
    null or non-finite component, and rows of null id, take no part; vectors
    meet those of their own length only. A query id that is repeated is asked
    once, with its smallest vector; rows with the query's id are not its
    candidates; other repeated ids are candidates each. Scores beyond a long
    are cut to its ends. Other columns are ignored; without queries or other
    rows the result is empty.
    """
    src = vectors.filter(V.usable(vector_col) & F.col(id_col).isNotNull())
    base = settle_table(src.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"),
        F.size(vector_col).alias("dim"), F.expr(is_query).alias("asks")))
    asked = settle_table(V.one_per_id(base.filter("asks"), "id", "v").select("id", "v", "dim"))
    cells = V.Cells(base, asked)
    one = cells.run(asked.withColumn("bound", F.lit(None).cast("bigint")), _cell(k, segments, scale, 1), RESULT)
    first = top_k(one, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    bound = settle(first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound")))
    limits = asked.join(bound, asked["id"] == bound["query_id"], "left").select("id", "v", "dim", "bound")
    found = cells.run(limits, _cell(k, segments, scale, 2), RESULT)
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
