"""Cascade of deleted source files through pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..plans.joins import attach
from ..session import settle
from .links import remove_links


def page_sources(pages: DataFrame, field: str = "source_path", listing: str = "sources") -> DataFrame:
    """note_name, pos, source, listed: where each page comes from."""
    single = M.nonblank(F.regexp_extract("content", rf"(?md)^{field}:\s*[\"']?(.+?)[\"']?\s*$", 1))
    both = pages.select("note_name", M.front_list("content", listing).alias("l"), single.alias("s"))
    return (
        both.select("note_name", F.posexplode("l").alias("pos", "source"), F.lit(True).alias("listed"))
        .unionByName(
            both.filter("s IS NOT NULL AND NOT array_contains(l, s)")
            .select("note_name", F.lit(-1).alias("pos"), F.col("s").alias("source"), F.lit(False).alias("listed"))
        )
    )


def cascade_plan(sources: DataFrame, deleted: DataFrame) -> DataFrame:
    """note_name, action, remaining for each page that cites a deleted source.

    delete: no listed source is left; update: others are left; keep: the
    source is named outside the list only. Groups are one page's sources.
    """
    gone = deleted.select("source").distinct().withColumn("_gone", F.lit(True))
    marked = sources.join(gone, "source", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    left = F.transform(
        F.sort_array(F.collect_list(F.when(~F.col("_gone") & F.col("listed"), F.struct("pos", "source")))),
        lambda s: s["source"],
    )
    per_page = marked.groupBy("note_name").agg(
        left.alias("remaining"),
        F.bool_or("_gone").alias("_hit"),
        F.bool_or(F.col("_gone") & F.col("listed")).alias("_listed"),
    )
    return per_page.filter("_hit").select(
        "note_name",
        F.when(~F.col("_listed"), "keep").when(F.size("remaining") == 0, "delete").otherwise("update").alias("action"),
        "remaining",
    )


def cascade_delete(pages: DataFrame, deleted: DataFrame, squeeze_all: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, pages afterwards): pages without sources go, the others lose the
    deleted sources and the links to removed pages."""
    plan = settle(cascade_plan(page_sources(pages), deleted))
    marked = attach(pages, plan.filter("action <> 'keep'"), "note_name")
    fixed = marked.filter("action IS NULL OR action <> 'delete'").withColumn(
        "content",
        F.when(F.col("remaining").isNotNull(), M.rewrite_list("content", "sources", "remaining", "'"))
        .otherwise(F.col("content")),
    ).select(*pages.columns)
    return plan, remove_links(fixed, plan.filter("action = 'delete'"), squeeze_all)
