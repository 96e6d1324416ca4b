"""Pairwise work inside groups without emitting pairs.

A group is cut into blocks of about ``block_rows`` rows; each pair of blocks is
one *cell*. A cell is the unit of work, so a group that holds a third of all
rows becomes many bounded cells on many tasks, and a small group is one cell.
Only what the cell function keeps (top-k rows, passing pairs) leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sizes(rows: DataFrame, key: list[str], block_rows: int) -> DataFrame:
    """key, _blocks for the groups that hold at least two rows."""
    return (
        rows.groupBy(*key)
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(*key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    )


def into_cells(rows: DataFrame, ident: str) -> DataFrame:
    """Send each row (which carries ``_blocks``) to the cells it takes part in.

    Adds ``_block``, ``_lo`` and ``_hi``; a cell compares block ``_lo`` with
    block ``_hi`` (the same block on the diagonal).
    """
    block = F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int")
    return (
        rows.withColumn("_block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_other", "_blocks")
    )


def task_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def run_cells(
    rows: DataFrame, key: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, pack_rows: int = 0
) -> DataFrame:
    """Apply ``fn`` to the rows of each cell, streaming cell by cell.

    ``pack_rows`` lets one call take several whole cells of up to that many
    rows together, for a function that tells them apart by their key or may
    compare across them. Memory per task is one Arrow batch plus one cell.
    """
    cell = [*key, "_lo", "_hi"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[pa.Table] = []  # complete cells that wait for a call
        current: list[pa.Table] = []  # the cell that may go on in the next batch
        last = None

        def rows_in(tables):
            return sum(x.num_rows for x in tables)

        def call(tables):
            out = fn(pa.concat_tables(tables)) if rows_in(tables) else None
            return [] if out is None else [out]

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            t = pa.Table.from_batches([batch])
            change = np.zeros(n, dtype=bool)
            for c in cell:
                col = t.column(c).combine_chunks()
                if n > 1:
                    change[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
            change[0] = last is None or tuple(t.column(c)[0].as_py() for c in cell) != last
            last = tuple(t.column(c)[n - 1].as_py() for c in cell)
            starts = np.flatnonzero(change)
            if len(starts) == 0:
                current.append(t)
                continue
            if starts[0] > 0:
                current.append(t.slice(0, int(starts[0])))
            if rows_in(whole) + rows_in(current) > pack_rows:
                yield from call(whole)
                whole = []
            whole += current
            begin, waiting = int(starts[0]), rows_in(whole)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if waiting + (s - begin) and waiting + (e - begin) > pack_rows:
                    yield from call([*whole, t.slice(begin, s - begin)])
                    whole, waiting, begin = [], 0, s
            whole.append(t.slice(begin, int(starts[-1]) - begin))
            current = [t.slice(int(starts[-1]))]
        if rows_in(whole) + rows_in(current) > pack_rows:
            yield from call(whole)
            whole = []
        yield from call([*whole, *current])

    spread = rows.repartition(task_count(rows), *cell).sortWithinPartitions(*cell)
    return spread.mapInArrow(step, schema)


def list_codes(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, sizes) of a list column; codes are dense integers."""
    arr = col.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0)
    sizes = pc.list_value_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, code = np.unique(flat, return_inverse=True)
    return row, code, sizes


def shared_counts(row: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of codes shared by each (left, right) pair of rows."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if len(code) == 0:
        return out
    uses = np.bincount(code)
    keep = uses[code] > 1
    row, code = row[keep], code[keep]
    if len(code) == 0:
        return out
    _, code = np.unique(code, return_inverse=True)
    n_rows, width = int(max(left.max(), right.max())) + 1, 4096
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(code[-1]) + 1, width):
        lo, hi = np.searchsorted(code, [start, start + width])
        m = np.zeros((n_rows, min(width, int(code[-1]) + 1 - start)), dtype=np.float32)
        m[row[lo:hi], code[lo:hi] - start] = 1.0
        out += m[left] @ m[right].T
    return out
