"""Joins that keep wide rows where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

MAX_BYTES = 64 * 1024 * 1024


def attach(wide: DataFrame, facts: DataFrame, on: str | list[str], how: str = "left", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Join wide rows (page texts) with facts about some of them.

    The facts are settled and measured. Up to ``max_bytes`` they are sent to
    every task, so the texts are not shuffled; larger ones take a shuffle join.
    """
    facts = settle(facts)
    size = facts.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0] or 0
    return wide.join(F.broadcast(facts) if size <= max_bytes else facts, on, how)
