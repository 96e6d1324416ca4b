"""Packing: best-fit decreasing over token windows.

Overlong documents are first cut into full windows. What is left is one piece
of 1 to ``window`` tokens per document. Best-fit decreasing looks only at piece
lengths, so it runs on the number of pieces of each length - at most ``window``
numbers, whatever the size of the input - and yields runs: the pieces of one
length with ranks a to b go, k per sequence, to sequences s, s + 1, ... at one
place. A segment tree indexed by remaining capacity finds the tightest open
sequences. Each piece then finds its run by length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import group_rank
from ..session import settle_table
from . import words as W
from .vocabulary import Encoder, plain_words

#: Words that a task remembers with their ids.
TASK_WORDS = 300_000
RUN = "length long, first long, last long, per long, sequence long, place long"


class CapacityTree:
    """Segment tree over remaining capacities 0..n: which are open."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest open capacity that is at least ``need``."""
        i = self.leaves + need
        if not self.open[i]:
            while i > 1 and (i % 2 or not self.open[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_runs(counts: dict[int, int], window: int, start: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, pieces per sequence, first sequence, place).

    The same placement as best-fit decreasing over the single pieces: equal
    pieces are placed in rank order, each into the tightest open sequence.
    Sequences of one remaining capacity that lie side by side are one range.
    """
    tree, ranges = CapacityTree(window), defaultdict(list)  # capacity -> [(first sequence, count)]
    runs, fresh = [], start

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            ranges[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 1
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # new sequences
                per = window // length
                capacity, first, count = window, fresh, -(-left // per)
                fresh += count
            else:
                first, count = ranges[capacity].pop()
                if not ranges[capacity]:
                    tree.set(capacity, False)
                per = capacity // length
            full = min(count, left // per)
            if full:
                runs.append((length, rank, rank + full * per - 1, per, first, window - capacity))
                put(capacity - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            rest = count - full
            if rest and left:  # fewer than per are left: they share the next sequence
                runs.append((length, rank, rank + left - 1, per, first + full, window - capacity))
                put(capacity - left * length, first + full, 1)
                put(capacity, first + full + 1, rest - 1)
                rank, left = rank + left, 0
            elif rest:
                put(capacity, first + full, rest)
    return runs


def _encode(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encoder(path, TASK_WORDS)  # the task's own: a worker that lives on keeps no words
        for part in W.blocks(batches, "text", 1 << 20):
            w = W.split(plain_words(part.column("text")))
            offsets, ids = known.table(w.vocabulary.to_pylist())
            count = np.diff(offsets)[w.codes]
            flat = ids[W.take_ranges(offsets[:-1][w.codes], count)].astype("<u4")
            ends = np.concatenate(([0], np.cumsum(count)))[w.offsets]
            row, start, length, crc, total = [], [], [], [], []
            last = np.array([end_id], "<u4").tobytes()
            for i in range(part.num_rows):
                text = flat[ends[i]:ends[i + 1]]
                n = len(text) + 1
                for lo in range(0, n, window):
                    hi = min(n, lo + window)
                    c = zlib.crc32(text[lo:hi].tobytes())
                    row.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(last, c) if hi == n else c)
                    total.append(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("uid").take(at), part.column("id").take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["uid", "id", "start", "length", "ids_crc32", "doc_tokens"])
        del known
        W.release()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
         end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, then ``end_id``, lie in pieces of at most ``window``
    ids: full windows and one rest. Pieces of a sequence are side by side from
    offset 0. A null or empty text is ``end_id`` alone. Rows that repeat an id
    or have a null id are packed one by one; other columns are ignored; an
    empty table gives an empty result. Equal pieces are placed by id, then by
    their place in the input.
    """
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"),
                      F.col(text_col).alias("text"))
    pieces = settle_table(src.mapInArrow(
        _encode(tokenizer, window, end_id), "uid long, id long, start long, length long, ids_crc32 long, doc_tokens long"))
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= window rows
    runs = F.broadcast(spark.createDataFrame(best_fit_runs(counts, window), RUN))
    ranked = group_rank(pieces.withColumn("order", F.coalesce("id", F.lit(-1 << 63))), ["length"], ["order", "uid", "start"], "rank")
    at = F.col("rank") - F.col("first")
    fit = [F.col("length") == F.col("run_length"), F.col("rank").between(F.col("first"), F.col("last"))]
    return ranked.join(runs.withColumnRenamed("length", "run_length"), fit).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + (at % F.col("per")) * F.col("length")).cast("bigint").alias("offset"))
