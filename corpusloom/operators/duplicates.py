"""Duplicate pages: same page key and similar titles."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions import paths as P
from ..plans import blocks
from ..plans.components import components
from ..plans.joins import attach
from ..plans.ranking import top_k
from .links import rewrite_links

PAIR_SCHEMA = ("page_key string, title_a string, title_b string, first_a string, first_b string, "
               "n_a bigint, n_b bigint, similarity double, reverse double")
PAIR_NAMES = [c.strip().split(" ")[0] for c in PAIR_SCHEMA.split(",")]


def common_lengths(a: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Longest common subsequence of one text (at most 64 letters) with each
    row of ``table``; letters are codes from 1, rows are padded with 0.

    Bit-parallel over the letters of ``a``, vectorised over the rows.
    """
    mask = np.zeros(max(int(table.max(initial=0)), int(a.max(initial=0))) + 1, dtype=np.uint64)
    for i, c in enumerate(a):
        mask[c] |= np.uint64(1) << np.uint64(i)
    mask[0] = 0
    v = np.full(len(table), ~np.uint64(0))
    for p in range(table.shape[1]):
        u = v & mask[table[:, p]]
        v = (v + u) | (v - u)
    low = ~np.uint64(0) if len(a) == 64 else (np.uint64(1) << np.uint64(len(a))) - np.uint64(1)
    return np.bitwise_count(~v & low).astype(np.int64)


def title_groups(pages: DataFrame) -> DataFrame:
    """page_key, title, n, first, last: pages with one title under one key.

    pages: page_path, page_key, title. Pages with equal titles are counted
    here and are not compared again.
    """
    return pages.groupBy("page_key", F.coalesce("title", F.lit("")).alias("title")).agg(
        F.count("*").alias("n"), F.min("page_path").alias("first"), F.max("page_path").alias("last")
    )


def _cell_pairs(threshold: float):
    """Passing title pairs of a cell.

    The ratio counts letters of a common subsequence, so lengths and the
    longest common subsequence bound it and rule out nearly all pairs before
    the exact ratio is taken.
    """

    def near(title, first, last, block, split):
        """(i, j, ratio, ratio the other way) of the pairs of one cell."""
        low = [s.lower() for s in title]
        size = np.array([len(s) for s in low])
        many = len(low) > 16
        if many:
            letters = {c: i for i, c in enumerate(sorted(set("".join(low))), 1)}
            table = np.zeros((len(low), int(size.max())), dtype=np.int32)
            for i, s in enumerate(low):
                table[i, : len(s)] = [letters[c] for c in s]
        match = SequenceMatcher(None)
        for j in range(1, len(low)):
            rest = np.arange(j)
            if split:
                rest = rest[block[:j] != block[j]]
            rest = rest[2 * np.minimum(size[j], size[rest]) >= threshold * (size[j] + size[rest]) - 1e-9]
            if many and len(rest) and size[j] <= 64:
                common = common_lengths(table[j, : size[j]], table[rest, : size[rest].max()])
                rest = rest[2 * common >= threshold * (size[j] + size[rest]) - 1e-9]
            if len(rest):
                match.set_seq2(low[j])
            for i in rest.tolist():
                match.set_seq1(low[i])
                sim = match.ratio()
                rev = SequenceMatcher(None, low[j], low[i]).ratio() if first[j] < last[i] else None
                if sim >= threshold or (rev is not None and rev >= threshold):
                    yield i, j, sim, rev

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        names = ["page_key", "_lo", "_hi", "first"]
        d = t.sort_by([(c, "ascending") for c in names]).to_pydict()
        cell = list(zip(d["page_key"], d["_lo"], d["_hi"]))
        cuts = [0, *[i for i in range(1, len(cell)) if cell[i] != cell[i - 1]], len(cell)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            part = {c: d[c][lo:hi] for c in ("title", "first", "last", "n")}
            split = cell[lo][1] != cell[lo][2]
            for i, j, sim, rev in near(part["title"], part["first"], part["last"], np.array(d["_block"][lo:hi]), split):
                out.append((cell[lo][0], part["title"][i], part["title"][j], part["first"][i], part["first"][j],
                            part["n"][i], part["n"][j], sim, rev))
        if not out:
            return None
        types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], PAIR_NAMES)

    return pairs


def duplicate_titles(pages: DataFrame, threshold: float = K.TITLE_SIMILARITY, block_rows: int = 512) -> DataFrame:
    """Title pairs whose pages are likely duplicates.

    A row stands for all n_a x n_b page pairs of the two titles (for equal
    titles: all pairs among n_a pages); ``similarity`` holds where the page
    with title_a has the smaller path, ``reverse`` the other way round (NULL
    when no such pair exists). A blank title matches every title of its key.
    """
    g = title_groups(pages).filter("page_key <> ''")
    same = g.filter("n > 1").select(
        "page_key", F.col("title").alias("title_a"), F.col("title").alias("title_b"), F.col("first").alias("first_a"),
        F.col("first").alias("first_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"),
        F.lit(1.0).alias("similarity"), F.lit(1.0).alias("reverse"))
    blank = g.filter("title = ''").select("page_key", F.col("first").alias("f0"), F.col("last").alias("l0"), F.col("n").alias("n0"))
    other = g.filter("title <> ''")
    near = other.join(blank, "page_key")
    swap = F.col("first") < F.col("f0")
    pick = lambda x, y: F.when(swap, x).otherwise(y)
    back = F.when(pick(F.col("f0") < F.col("last"), F.col("first") < F.col("l0")), F.lit(1.0))
    blanks = near.select(
        "page_key", pick(F.col("title"), F.lit("")).alias("title_a"), pick(F.lit(""), F.col("title")).alias("title_b"),
        F.least("first", "f0").alias("first_a"), F.greatest("first", "f0").alias("first_b"),
        pick(F.col("n"), F.col("n0")).alias("n_a"), pick(F.col("n0"), F.col("n")).alias("n_b"),
        F.lit(1.0).alias("similarity"), back.alias("reverse"))
    sized = other.join(blocks.group_sizes(other, ["page_key"], block_rows), "page_key")
    fuzzy = blocks.run_cells(blocks.into_cells(sized, "first"), ["page_key"], _cell_pairs(threshold), PAIR_SCHEMA, pack_rows=4096)
    return same.unionByName(blanks).unionByName(fuzzy)


def duplicate_map(pages: DataFrame, threshold: float = K.TITLE_SIMILARITY) -> DataFrame:
    """page_path, canonical for each page that has a duplicate (chains joined);
    the canonical page is the one with the smallest path."""
    pairs = duplicate_titles(pages, threshold)
    roots = components(pairs, "first_a", "first_b")
    g = title_groups(pages).filter("page_key <> ''")
    where = g.join(roots, F.col("first") == F.col("node"), "left").select(
        "page_key", "title", F.coalesce("root", "first").alias("canonical"), (F.col("n") > 1).alias("_many"), F.col("root").isNotNull().alias("_linked"))
    keyed = pages.select("page_path", "page_key", F.coalesce("title", F.lit("")).alias("title"))
    return keyed.join(where.filter("_many OR _linked").drop("_many", "_linked"), ["page_key", "title"]).select("page_path", "canonical")


def merge_duplicates(pages: DataFrame, dup_map: DataFrame, note_names: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages afterwards, rename map old -> new).

    pages: page_path, content, … The canonical page gets the union of the
    sources and tags and a note naming the merged pages; the others go, and
    links to their paths point to the canonical one. The note lists every
    merged page; with ``note_names`` it lists that many and their number.
    """
    gone = dup_map.filter("page_path <> canonical")
    member = dup_map.join(pages.select("page_path", "content"), "page_path").select(
        "canonical", M.front_list("content", "sources").alias("sources"), M.front_list("content", "tags").alias("tags"))

    def union_of(c):
        return member.select("canonical", F.explode(c).alias("v")).distinct().groupBy("canonical").agg(
            F.sort_array(F.collect_list("v")).alias("_" + c))

    names = gone.select("canonical", P.basename("page_path").alias("v"), "page_path")
    if note_names is not None:
        names = top_k(names, ["canonical"], [F.col("page_path").asc()], note_names)
    listed = names.groupBy("canonical").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("page_path", "v"))), lambda s: s["v"]).alias("_names"))
    count = gone.groupBy("canonical").agg(F.count("*").alias("_count"))
    add = count.join(listed, "canonical").join(union_of("sources"), "canonical", "left").join(
        union_of("tags"), "canonical", "left").withColumnRenamed("canonical", "page_path")
    kept = attach(attach(pages, gone.select("page_path"), "page_path", "left_anti"), add, "page_path")
    text = F.col("content")
    for c in ("sources", "tags"):
        has = (F.coalesce(F.size("_" + c), F.lit(0)) > 0) & F.contains(M.front_block("content"), F.lit(c + ":"))
        text = F.when(has, M.rewrite_list(text, c, "_" + c, '"')).otherwise(text)
    more = F.when(F.col("_count") > F.size("_names"), F.concat(F.lit(" … "), F.col("_count").cast("string"))).otherwise("")
    note = F.concat(F.lit("\n" + K.MERGED_FROM_PREFIX), F.array_join("_names", ", "), more, F.lit("\n"))
    end = F.locate("---\n", F.col("_text"), 5)
    with_note = F.when(
        F.col("_names").isNotNull() & (end > 0) & ~F.contains(F.col("_text"), note),
        F.concat(F.substr("_text", F.lit(1), end + 3), note, F.substr("_text", end + 4)),
    ).otherwise(F.col("_text"))
    merged = kept.withColumn("_text", text).withColumn("content", with_note).select(*pages.columns)
    link = P.without_suffix
    rename = gone.select(link("page_path").alias("old"), link("canonical").alias("new"))
    merged = merged.withColumn("note_name", link("page_path"))
    return rewrite_links(merged, rename), rename
