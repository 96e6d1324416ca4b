"""Running values over long ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_streaks(
    df: DataFrame, key: str, order: list[str], bucket: Column, reset: Column, counted: dict[str, Column],
    initial: DataFrame | None = None,
) -> DataFrame:
    """For each row, how many ``counted`` rows came since the last ``reset``.

    One column per entry of ``counted`` (rows that are neither leave the
    streak as it is). ``bucket`` cuts each key's rows into ordered pieces that
    are scanned apart; a piece is summed up as one row (had a reset, counts
    since its last reset), the pieces are scanned, and each row before the
    first reset of its piece adds what is carried in. A key with a third of
    all rows thus spreads over its pieces. ``initial`` (key and the counted
    names) is what each key carries in from before.
    """
    names = list(counted)
    rows = df.withColumn("_b", bucket).withColumn("_r", reset.cast("int"))
    for n in names:
        rows = rows.withColumn(f"_c_{n}", counted[n].cast("int"))
    w = Window.partitionBy(key, "_b").orderBy(*order)
    rows = rows.withColumn("_isl", F.sum("_r").over(w))
    wi = Window.partitionBy(key, "_b", "_isl").orderBy(*order)
    for n in names:
        rows = rows.withColumn(f"_s_{n}", F.sum(f"_c_{n}").over(wi))

    at_end = F.struct(*order)
    piece = rows.groupBy(key, "_b").agg(
        F.max("_isl").alias("_resets"), *[F.max_by(f"_s_{n}", at_end).alias(f"_t_{n}") for n in names]
    )
    if initial is not None:
        before = initial.select(
            key, F.lit(-(1 << 62)).alias("_b"), F.lit(0).cast("bigint").alias("_resets"),
            *[F.col(n).alias(f"_t_{n}") for n in names])
        piece = piece.unionByName(before)
    wp = Window.partitionBy(key).orderBy("_b")
    piece = piece.withColumn("_pi", F.sum((F.col("_resets") > 0).cast("int")).over(wp))
    wpi = Window.partitionBy(key, "_pi").orderBy("_b")
    for n in names:
        piece = piece.withColumn(f"_o_{n}", F.sum(f"_t_{n}").over(wpi))
    for n in names:
        piece = piece.withColumn(f"_in_{n}", F.coalesce(F.lag(f"_o_{n}").over(wp), F.lit(0)))
    carried = piece.select(key, "_b", *[f"_in_{n}" for n in names])

    out = rows.join(carried, [key, "_b"])
    for n in names:
        out = out.withColumn(
            n, F.col(f"_s_{n}") + F.when(F.col("_isl") == 0, F.col(f"_in_{n}")).otherwise(0)
        )
    return out.select(*df.columns, *names)
