"""Keyed state tables: known content, changes, cache, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import latest

STATUSES = ["success", "failed", "updated", "unchanged"]


def exact_groups(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """md5, n, first id of every distinct content."""
    return docs.groupBy(F.md5(F.col(text).cast("binary")).alias("md5")).agg(
        F.count("*").alias("n"), F.min(ident).alias("first_id")
    )


def skip_known(batch: DataFrame, index: DataFrame, key: str = "md5", within_batch: bool = False,
               order: list[Column] | None = None) -> DataFrame:
    """Rows of the batch whose content is not in the index.

    Copies inside one batch all pass unless ``within_batch`` keeps the first.
    """
    fresh = batch.join(index.select(key).distinct(), key, "left_anti")
    return latest(fresh, [key], order or [F.col(key)]) if within_batch else fresh


def known(batch: DataFrame, index: DataFrame, key: str = "md5") -> DataFrame:
    """Rows of the batch with the record of the same content in the index."""
    return batch.join(index, key)


def detect_changes(inventory: DataFrame, status: DataFrame) -> DataFrame:
    """path, prev_status, change (new / changed / same).

    Changed means another md5 or size; the modification time is not compared.
    """
    old = status.select(
        "path", F.col("status").alias("prev_status"), F.col("md5").alias("_m"), F.col("size").alias("_s"),
        F.lit(True).alias("_seen"),
    )
    same = F.col("md5").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    return inventory.join(old, "path", "left").select(
        "path", "prev_status",
        F.when(F.col("_seen").isNull(), "new").when(same, "same").otherwise("changed").alias("change"),
    )


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Union of both tables with one row per key: the first in ``order``."""
    return latest(base.unionByName(delta, allowMissingColumns=True), keys, order)


def replace_rows(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta win over rows of base; delta has one row per key."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def insert_missing(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add the first row per key that base does not hold yet."""
    fresh = latest(delta.join(base.select(*keys), keys, "left_anti"), keys, order)
    return base.unionByName(fresh, allowMissingColumns=True)


def status_summary(status: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """status, n with a zero row for each known status."""
    zero = status.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status"), F.lit(0).cast("bigint").alias("n")
    )
    return status.groupBy("status").agg(F.count("*").alias("n")).unionByName(zero).groupBy("status").agg(
        F.sum("n").alias("n")
    )


# ---- content cache ------------------------------------------------------------

def cache_lookup(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """Inventory rows with ``hit`` and, on a hit, the cached category."""
    entry = cache.select("path", F.col("sha256").alias("_h"), F.col("category").alias("cached_category"))
    hit = F.coalesce(F.col("sha256") == F.col("_h"), F.lit(False))
    return inventory.join(entry, "path", "left").select(
        "path", hit.alias("hit"), F.when(hit, F.col("cached_category")).alias("cached_category")
    )


def cache_get(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Entries whose source still exists."""
    return cache.join(inventory.select("path"), "path", "left_semi")


def cache_invalidate(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("path"), "path", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and the bytes of their keys, hashes and categories."""
    size = F.octet_length("path") + F.octet_length("sha256") + F.octet_length("category")
    return cache.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("bytes")
    )


def register_unsupported(files: DataFrame) -> DataFrame:
    """Status rows for files no parser takes: recorded, no page is made."""
    return files.select("path", F.lit("unsupported").alias("status"), "category", "ext")
