"""Vault repair: categories, folders, legacy layout, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import paths as P
from ..plans.joins import attach
from ..plans.ranking import latest


def align_plan(pages: DataFrame, files: DataFrame) -> DataFrame:
    """rel_path, target, action (move / skip): pages go to the folder of the
    source file with the same stem. pages, files: rel_path.

    Of several source files with one stem the last in walk order counts.
    """
    src = latest(
        files.select(P.stem("rel_path").alias("stem"), P.dirname("rel_path").alias("dir"), "rel_path"),
        ["stem"], [P.walk_order("rel_path").desc()]).select("stem", "dir")
    p = pages.filter(~F.startswith(P.basename("rel_path"), F.lit("MOC"))).select("rel_path", P.stem("rel_path").alias("stem"))
    j = p.join(src, "stem", "left")
    move = F.col("dir").isNotNull() & (F.col("dir") != P.dirname("rel_path"))
    target = F.concat(F.col("dir"), F.when(F.col("dir") == "", "").otherwise("/"), P.basename("rel_path"))
    return j.select("rel_path", F.when(move, target).otherwise(F.col("rel_path")).alias("target"),
                    F.when(move, "move").otherwise("skip").alias("action"))


def repair_plan(pages: DataFrame, files: DataFrame, prefix: str = "source/") -> DataFrame:
    """rel_path, old_category, category, fix_category, fix_dir, action.

    pages: rel_path, content; files: vault_path, rel_path (source-relative) of
    the existing sources. ``original_path`` with the prefix is source-relative
    and always resolves; another one must be an existing file.
    """
    orig = M.line_value("content", "original_path", last=True)
    p = pages.filter(~F.startswith(P.basename("rel_path"), F.lit("MOC"))).select(
        F.col("rel_path").alias("page"), orig.alias("orig"), M.line_value("content", "category", last=True).alias("old_category"))
    inside = files.select(F.col("vault_path").alias("orig"), F.col("rel_path").alias("_src")).dropDuplicates(["orig"])
    j = p.join(inside, "orig", "left")
    src = F.when(F.startswith("orig", F.lit(prefix)), F.substr("orig", F.lit(len(prefix) + 1))).otherwise(F.col("_src"))
    j = j.withColumn("_rel", F.when(F.col("orig") != "", src))
    j = j.withColumn("category", P.source_category("_rel"))
    fix_cat = F.coalesce(F.col("category") != F.col("old_category"), F.lit(False))
    fix_dir = F.coalesce(F.col("category") != P.dirname("page"), F.lit(False))
    action = F.when(F.col("_rel").isNull(), "skip").when(fix_dir, "move").when(fix_cat, "rewrite").otherwise("skip")
    return j.select(F.col("page").alias("rel_path"), "old_category", "category", fix_cat.alias("fix_category"),
                    fix_dir.alias("fix_dir"), action.alias("action"))


def apply_repair(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages with corrected category line and rel_path."""
    todo = plan.filter("action <> 'skip'").select(
        "rel_path", F.col("old_category").alias("_old"), F.col("category").alias("_cat"),
        F.col("fix_category").alias("_fix"), F.col("fix_dir").alias("_move"))
    j = attach(pages, todo, "rel_path")
    old = F.concat(F.lit("category: "), "_old")
    at = F.instr(F.col("content"), old)
    fixed = F.concat(
        F.substr("content", F.lit(1), at - 1), F.lit("category: "), F.col("_cat"),
        F.substr("content", at + F.length(old)))
    target = F.concat_ws("/", F.when(F.col("_cat") != "", F.col("_cat")), P.basename("rel_path"))
    return j.withColumn(
        "content", F.when(F.col("_fix") & (at > 0), fixed).otherwise(F.col("content"))
    ).withColumn("rel_path", F.when(F.col("_move"), target).otherwise(F.col("rel_path"))).select(*pages.columns)


def page_origins(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per original_path (last page in walk order): orig, rel_path, category."""
    head = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    rows = pages.filter(
        ~F.contains(P.dirname("rel_path"), F.lit("_failed")) & ~F.contains(P.dirname("rel_path"), F.lit("_archive"))
        & ~F.startswith(P.basename("rel_path"), F.lit("MOC"))
    ).select(M.line_value(head, "original_path", True).alias("orig"), "rel_path",
             M.line_value(head, "category", True).alias("category")).filter("orig <> ''")
    return latest(rows, ["orig"], [P.walk_order("rel_path").desc()])


def reconcile(pages: DataFrame, files: DataFrame, prefix: str = "source/") -> DataFrame:
    """rel_path, source of pages whose source file is gone. files: rel_path."""
    o = page_origins(pages)
    src: Column = F.when(F.startswith("orig", F.lit(prefix)), F.substr("orig", F.lit(len(prefix) + 1))).otherwise(F.col("orig"))
    return o.withColumn("source", src).join(
        files.select(F.col("rel_path").alias("source")), "source", "left_anti").select("rel_path", "source")


def migrate(pages: DataFrame) -> DataFrame:
    """Pages with the reference block in link form, and ``changed``."""
    new = M.migrate_references("content", "rel_path")
    return pages.withColumn("_new", new).withColumn("changed", F.col("_new") != F.col("content")).withColumn(
        "content", F.col("_new")).drop("_new")
