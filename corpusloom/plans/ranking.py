"""Ranks: top-k in a group and a row number over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. Spark cuts each map task's rows to k per group
    before the shuffle (WindowGroupLimit), so a hot key moves few rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def global_rank(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """1-based row number over the whole table in ascending ``order``.

    A range shuffle and a sort per partition replace the one-task global
    window; the placed rows are checkpointed so that counting and numbering
    see the same partitions, then each partition adds the rows before it.
    The offsets have one row per partition. ``order`` must be unique per row
    so that equal keys cannot pile up in one partition.
    """
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_off") + F.col("_seq") + 1)
        .drop("_part", "_seq", "_off")
    )


def group_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """1-based row number within each group, ascending ``order`` (unique in
    the group). A global rank minus the group's first one: a group of any size
    is spread over many partitions."""
    ranked = global_rank(df, [*keys, *order], "_g")
    first = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_g").alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(first, same).select(*df.columns, (F.col("_g") - F.col("_first") + 1).alias(out))
