"""Approximate nearest neighbours by multiprobe p-stable hashing.

Table t hashes a vector x to floor((a x + b) / w) for several Gaussian a, so
near vectors tend to share a bucket. A query also visits buckets that differ in
some coordinates by one, in the order of the summed squared distances of its
projections to the borders crossed: the estimated order of success. Members and
probes meet in their bucket (a large one in blocks), each task ranks what a
query finds there by exact distance, and the finds of all tables are merged.

Every row is in the index, with one entry per table. Of equal vectors only the
k + 1 smallest ids can be among the k nearest, so the others stay out of the
buckets. A query that finds fewer than k is searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_k
from ..session import settle, settle_table
from . import vectors as V

#: Members and probes of one task unit.
BUCKET, BUCKET_PROBES = 4096, 2048
FOUND = "query_id long, vec_id long, score double"


class Hashes:
    """The hash functions of all tables for one dimension."""

    def __init__(self, dim: int, tables: int, functions: int, width: float):
        rng = np.random.default_rng([dim, tables, functions])
        self.a = rng.standard_normal((tables, max(1, dim), functions))[:, :dim]
        self.b = rng.uniform(0, width, (tables, functions))
        self.factors = rng.integers(1, 1 << 62, functions, dtype=np.int64) | 1
        self.width = width

    def place(self, x: np.ndarray, table: int) -> np.ndarray:
        """Projections in units of the width."""
        return (x @ self.a[table] + self.b[table]) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.factors).sum(axis=-1)


def perturbations(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The ``probes`` likeliest sets of (coordinate, step), the empty one first.

    ``inside``: place of the query within its cell, 0 to 1, per coordinate.
    """
    size = len(inside)
    far = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(far, kind="stable")
    cost, coordinate = far[order].tolist(), (order % size).tolist()
    step = np.where(order < size, -1, 1).tolist()
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if len({coordinate[i] for i in chosen}) == len(chosen):
            out.append([(coordinate[i], step[i]) for i in chosen])
        last = chosen[-1]
        if last + 1 < 2 * size:  # take one more, or the next instead of the last
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    return out


def _entries(tables: int, functions: int, width: float, probes: int | None):
    """(table, bucket) of every vector, or the buckets that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                rows = np.flatnonzero(batch.column("dim").to_numpy() == dim)
                part = batch.take(pa.array(rows))
                x = V.matrix(part.column("v")).astype(np.float64)
                h = Hashes(dim, tables, functions, width)
                for t in range(tables):
                    at = h.place(x, t)
                    # a projection beyond this range would not fit a cell number
                    cell = np.clip(np.floor(at), -(2**40), 2**40)
                    if probes is None:
                        row, key = np.arange(len(x)), h.keys(cell.astype(np.int64))
                    else:
                        found, row = [], []
                        for i, inside in enumerate(np.clip(at - cell, 0, 1)):
                            steps = np.zeros((probes, functions), np.int64)
                            sets = perturbations(inside, probes)
                            for j, chosen in enumerate(sets):
                                for c, s in chosen:
                                    steps[j, c] = s
                            found.append(h.keys(cell[i].astype(np.int64) + steps[:len(sets)]))
                            row += [i] * len(sets)
                        row, key = np.array(row), np.concatenate(found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(row)), pa.array(np.full(len(row), dim, np.int32)),
                         pa.array(np.full(len(row), t, np.int32)), pa.array(key)], names=["id", "dim", "t", "bucket"])

    return run


def nearest(q: np.ndarray, qid: int, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest other rows."""
    other = np.flatnonzero(ids != qid)
    d = c[other].astype(np.float64) - q.astype(np.float64)
    score = np.sqrt((d * d).sum(axis=1))
    at = V.best(-score, ids[other], k)
    return ids[other][at], score[at]


def _bucket_search(k: int, flush: int = 20_000):
    """Per task the k nearest that each query finds in the task's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def give():
            sizes = [len(i) for i, _ in kept.values()]
            cols = (np.repeat(np.array(list(kept), np.int64), sizes), np.concatenate([i for i, _ in kept.values()]),
                    np.concatenate([s for _, s in kept.values()]))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for cell in batch.column("rows"):
                rows = cell.values
                asks = rows.field("asks").to_numpy(zero_copy_only=False)
                if asks.all() or not asks.any():
                    continue
                ids, x = rows.field("id").to_numpy(), V.matrix(rows.field("v"))
                members, own = ids[~asks], x[~asks]
                for qid, q in zip(ids[asks].tolist(), x[asks], strict=True):
                    found, score = nearest(q, qid, own, members, k)
                    if qid in kept:
                        new = ~np.isin(found, kept[qid][0])
                        found = np.concatenate((kept[qid][0], found[new]))
                        score = np.concatenate((kept[qid][1], score[new]))
                        at = V.best(-score, found, k)
                        found, score = found[at], score[at]
                    kept[qid] = found, score
                if len(kept) >= flush:
                    yield give()
        if kept:
            yield give()

    return run


def _exact_cell(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            q, c = (V.matrix(t.column("v").combine_chunks()) for t in (queries, candidates))
            for qid, x in zip(queries.column("id").to_pylist(), q, strict=True):
                out += [(qid, i, s) for i, s in zip(*nearest(x, qid, c, candidates.column("id").to_numpy(), k), strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = 10, is_query: str = "vec_id % 100 = 0", id_col: str = "vec_id",
           vector_col: str = "embedding", tables: int = 10, functions: int = 6, width: float = 1.5, probes: int = 80) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of the other rows.

    score is the Euclidean distance in double precision; ties go to smaller
    ids. ``width`` is in units of the vectors' root mean square length. Vectors
    that are null, zero or hold a null or non-finite component, and rows of
    null id, take no part; vectors meet those of their own length only. Rows
    that repeat an id count once, with the smallest vector. Other columns are
    ignored; without queries or other rows the result is empty.
    """
    zero = ~F.exists(vector_col, lambda x: x != 0)
    src = vectors.filter(V.usable(vector_col) & F.col(id_col).isNotNull()).filter(~zero)
    base = src.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"),
                      F.expr(is_query).alias("asks"))
    base = settle_table(V.one_per_id(base, "id", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = base.agg(F.sqrt(F.avg(square)).alias("r")).first()["r"] or 1.0
    scale = width * float(f"{length:.3g}")  # the same in every run, whatever the order of the sum
    asked = base.filter("asks").select("id", "v", "dim")
    kept = settle_table(top_k(base, ["v"], [F.col("id")], k + 1, "_copy").select("id", "v", "dim"))
    hashed = "id long, dim int, t int, bucket long"
    member = kept.mapInArrow(_entries(tables, functions, scale, None), hashed)
    probe = asked.mapInArrow(_entries(tables, functions, scale, probes), hashed)

    key = ["dim", "t", "bucket"]
    probe = settle(probe)
    parts = member.groupBy(*key).agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    visits = probe.groupBy(*key).agg(F.ceil(F.count("*") / BUCKET_PROBES).alias("visits"))
    size = settle(parts.join(visits, key))  # only buckets that a query visits
    m = (
        member.join(size, key).withColumn("mb", F.pmod(F.xxhash64("id"), F.col("parts")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("visits") - 1)))
        .select(*key, "mb", "qb", "id", F.lit(False).alias("asks"))
    )
    p = (
        probe.join(size, key).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("visits")))
        .withColumn("mb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select(*key, "mb", "qb", "id", F.lit(True).alias("asks"))
    )
    cells = (
        m.join(kept.select("id", "v"), "id").unionByName(p.join(asked.select("id", "v"), "id"))
        .groupBy(*key, "mb", "qb").agg(F.collect_list(F.struct("id", "asks", "v")).alias("rows"))
    )
    found = settle(cells.select("rows").mapInArrow(_bucket_search(k), FOUND).distinct())
    best = top_k(found, ["query_id"], [F.col("score"), F.col("vec_id")], k)

    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k)
    short = settle_table(asked.join(enough, "id", "left_anti"))
    exact = V.Cells(kept.withColumn("uid", F.col("id")), short).run(short, _exact_cell(k), FOUND)
    rest = top_k(exact, ["query_id"], [F.col("score"), F.col("vec_id")], k)
    found_all = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found_all.select("query_id", "rank", "vec_id", "score")
