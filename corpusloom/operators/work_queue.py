"""Task table: enqueue, transitions, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..plans.ranking import latest

STATES = ["pending", "processing", "done", "failed", "cancelled"]


def enqueue(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks plus one pending task per path not queued yet.

    tasks: task_id, path, status, retry_count, seq; files: path, seq (repeats
    of a path in the batch keep the first).
    """
    fresh = latest(files.join(tasks.select("path"), "path", "left_anti"), ["path"], [F.col("seq").asc()])
    new = fresh.select(
        F.substring(F.md5(F.col("path").cast("binary")), 1, 8).alias("task_id"), "path",
        F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("retry_count"), "seq")
    return tasks.select(*new.columns).unionByName(new)


def summary(tasks: DataFrame) -> DataFrame:
    """One row: total, count per state, is_empty, next_pending."""
    s = F.col("status")
    return tasks.agg(
        F.count("*").alias("total"),
        *[F.count_if(s == st).alias(st) for st in STATES],
        F.coalesce(F.bool_and(s.isin("done", "cancelled", "failed")), F.lit(True)).alias("is_empty"),
        F.min_by("path", F.when(s == "pending", F.col("seq"))).alias("next_pending"),
    )


def apply_outcomes(tasks: DataFrame, outcomes: DataFrame, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """Tasks after a table of outcomes (path, ord, outcome).

    Outcomes are done, fail, processing and cancel. A fail adds a retry and
    leaves the task pending until ``max_retries``, then failed; a cancel works
    only on a pending or processing task. The end state needs only the number
    of fails, the last outcome that is not a cancel and whether a cancel came
    after it, so the fold is one aggregation with map-side combine.
    """
    o = F.col("outcome")
    acts = o != "cancel"
    agg = outcomes.groupBy("path").agg(
        F.count_if(o == "fail").alias("_fails"),
        F.max_by("outcome", F.when(acts, F.col("ord"))).alias("_last"),
        F.max(F.when(acts, F.col("ord"))).alias("_last_ord"),
        F.max(F.when(~acts, F.col("ord"))).alias("_cancel_ord"),
    )
    j = tasks.join(agg, "path", "left").withColumn("retry_count", F.col("retry_count") + F.coalesce("_fails", F.lit(0)))
    state = (
        F.when(F.col("_last") == "done", "done").when(F.col("_last") == "processing", "processing")
        .when(F.col("_last") == "fail", F.when(F.col("retry_count") < max_retries, "pending").otherwise("failed"))
        .otherwise(F.col("status"))
    )
    late = F.col("_cancel_ord").isNotNull() & (F.col("_last_ord").isNull() | (F.col("_cancel_ord") > F.col("_last_ord")))
    end = F.when(late & state.isin("pending", "processing"), "cancelled").otherwise(state)
    return j.withColumn("status", end).select(*tasks.columns)


def retry_failed(tasks: DataFrame) -> DataFrame:
    bad = F.col("status") == "failed"
    return tasks.withColumn("retry_count", F.when(bad, F.lit(0)).otherwise(F.col("retry_count"))).withColumn(
        "status", F.when(bad, "pending").otherwise(F.col("status")))


def clear_completed(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.col("status").isin("done", "cancelled"))
