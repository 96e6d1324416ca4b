"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component.

    Each round takes the smallest label over the edges for a node and for the
    node's current root, then replaces each label by its label, so long chains
    shrink geometrically. Rounds are checkpointed; only
    whether labels changed comes back to the driver.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    both = settle(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = settle(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
        .select("node", F.least("node", "m").alias("root"))
    )
    for _ in range(max_rounds):
        near = (
            both.join(lab.select(F.col("node").alias("dst"), F.col("root").alias("cand")), "dst")
            .join(lab.select(F.col("node").alias("src"), "root"), "src")
        )
        best = (
            near.select(F.col("src").alias("node"), "cand")
            .unionByName(near.select(F.col("root").alias("node"), "cand"))
            .groupBy("node").agg(F.min("cand").alias("cand"))
        )
        hooked = lab.join(best, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("cand", "root")).alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = settle(hooked.join(jump, "root").select("node", "old", F.least("root", "up").alias("root")))
        lab = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return lab
    raise RuntimeError("components did not settle")
