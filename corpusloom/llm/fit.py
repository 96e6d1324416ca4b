"""Labelled samples for the classifiers: folds and a bounded choice of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_k


def held_out(id_col: str) -> Column:
    """True for the rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def class_sizes(labels: DataFrame, label: str, id_col: str = "doc_id") -> dict[int, int]:
    """Labelled rows of each class that may be learned from, at least 1."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).agg(F.count("*")).collect()}
    return {c: max(1, n.get(c, 0)) for c in (0, 1)}


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most ``per_class`` labelled rows of each class.

    The rows with the smallest hash of the id; held-out rows, null labels and
    null ids are left out. The ids are a bounded table, so the texts are not
    shuffled.
    """
    rows = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    )
    chosen = top_k(rows, ["label"], [F.md5(F.col("id").cast("string"))], per_class, "_n").drop("_n")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
