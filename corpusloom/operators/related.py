"""Related documents by shared tags, category and keywords."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..plans import blocks
from ..plans.joins import attach
from ..plans.ranking import top_k
from ..session import settle, settle_table


def _scorer(k: int, min_score: float):
    """Top-k members of a cell for each of its query rows, by score and name.

    Rows with ``role`` 2 are query and member at once, 0 only query, 1 only
    member. Scores are those of the whole profiles, so small cells may be
    handed over together; a profile that is in several counts once.
    """

    def score_cell(t: pa.Table) -> pa.RecordBatch | None:
        role = t.column("role").to_numpy()
        if len(role) and role[0] == 2:
            _, first = np.unique(t.column("pid").to_numpy(), return_index=True)
            t = t.take(pa.array(np.sort(first)))
            role = t.column("role").to_numpy()
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        if len(left) == 0 or len(right) == 0:
            return None
        tag_row, tag_code, _ = blocks.list_codes(t.column("tags"))
        kw_row, kw_code, kw_n = blocks.list_codes(t.column("words"))
        shared = blocks.shared_counts(tag_row, tag_code, left, right).astype(np.float64)
        inter = blocks.shared_counts(kw_row, kw_code, left, right).astype(np.float64)
        size = kw_n[left][:, None] + kw_n[right][None, :] - inter
        some = (kw_n[left] > 0)[:, None] & (kw_n[right] > 0)[None, :]
        jac = np.divide(inter, size, out=np.zeros_like(inter), where=some & (size > 0))
        _, cat = np.unique(t.column("category").to_numpy(zero_copy_only=False), return_inverse=True)
        same = (cat[left][:, None] == cat[right][None, :]).astype(np.float64)
        score = shared * K.TAG_WEIGHT + same * K.CATEGORY_WEIGHT + jac * K.KEYWORD_WEIGHT
        pid = t.column("pid").combine_chunks()
        _, own = np.unique(pid.to_numpy(zero_copy_only=False), return_inverse=True)
        score[(score < min_score) | (own[left][:, None] == own[right][None, :])] = -1.0
        _, name = np.unique(t.column("first_name").to_numpy(zero_copy_only=False), return_inverse=True)
        name = name[right]
        a_out, b_out, s_out = [], [], []
        for i in range(len(left)):
            row = score[i]
            best = np.flatnonzero(row >= 0)
            if len(best) > k:  # only rows that reach the k-th score can stay
                best = best[row[best] >= np.partition(row[best], -k)[-k]]
            best = best[np.lexsort((name[best], -row[best]))][:k]
            a_out.append(np.full(len(best), left[i]))
            b_out.append(right[best])
            s_out.append(row[best])
        a, b, s = np.concatenate(a_out), np.concatenate(b_out), np.concatenate(s_out)
        if len(a) == 0:
            return None
        return pa.RecordBatch.from_arrays(
            [pid.take(pa.array(a)), pid.take(pa.array(b)), pa.array(s)], ["pid", "other_pid", "score"]
        )

    return score_cell


SCORED = "pid string, other_pid string, score double"
MAX_SET = 3


def _subsets(tags: str) -> Column:
    """array<struct<key, s>>: the sets of one to three tags (two at most where
    a row has more than eight)."""
    t, n = F.col(tags), F.size(tags)
    rest = lambda i: F.slice(t, i + 2, n)
    one = F.transform(t, lambda x: F.struct(x.alias("key"), F.lit(1).alias("s")))
    two = F.flatten(F.transform(t, lambda x, i: F.transform(
        rest(i), lambda y: F.struct(F.concat(x, F.lit("\x03"), y).alias("key"), F.lit(2).alias("s")))))
    three = F.flatten(F.transform(t, lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(
        F.slice(t, i + j + 3, n),
        lambda z: F.struct(F.concat(x, F.lit("\x03"), y, F.lit("\x03"), z).alias("key"), F.lit(3).alias("s")))))))
    return F.concat(one, two, F.when(n <= 8, three).otherwise(F.slice(two, 1, 0)))


def _hot_partners(profiles: DataFrame, hot: DataFrame, cool: DataFrame, k: int, min_score: float,
                  block_rows: int) -> DataFrame:
    """Scored partners that meet only in groups of more than one block.

    A score is 3 x (shared tags) + (same category) + at most 0.5, so whoever
    has k partners above a level need not look below it. Levels come from the
    cool groups' k-th score and from the sizes of finer groups: sets of up to
    three hot tags, each with and without the category. A profile then asks
    only the groups that can still reach its level, and every other profile of
    such a group answers; both sides are cut into blocks.
    """
    tags = (
        profiles.select("pid", "category", F.explode("tags").alias("t"))
        .join(hot.select(F.col("meet").alias("m")), F.concat(F.lit("t"), F.col("t")) == F.col("m"))
        .groupBy("pid", "category").agg(F.sort_array(F.collect_list("t")).alias("hot_tags"))
    )
    sets = _subsets("hot_tags")
    plain = F.transform(sets, lambda e: F.struct(F.concat(F.lit("t"), e["key"]).alias("key"), e["s"].alias("s"), F.lit(0).alias("c")))
    with_cat = F.transform(sets, lambda e: F.struct(
        F.concat(F.lit("t"), e["key"], F.lit("\x04"), F.col("category")).alias("key"), e["s"].alias("s"), F.lit(1).alias("c")))
    member = tags.select("pid", F.size("hot_tags").alias("h"), F.explode(F.concat(plain, with_cat)).alias("e")).select(
        "pid", "h", "e.key", "e.s", "e.c")
    if min_score <= K.CATEGORY_WEIGHT + K.KEYWORD_WEIGHT:
        extra = profiles.select("pid", F.lit(0).alias("h"), F.concat(F.lit("c"), "category").alias("key"), F.lit(0).alias("s"), F.lit(1).alias("c"))
        member = member.unionByName(extra.join(hot.select(F.col("meet").alias("key")), "key", "left_semi"))
    if min_score <= K.KEYWORD_WEIGHT:
        extra = profiles.select("pid", F.lit(0).alias("h"), F.explode("words").alias("w")).select(
            "pid", "h", F.concat(F.lit("w"), F.col("w").cast("string")).alias("key"), F.lit(0).alias("s"), F.lit(0).alias("c"))
        member = member.unionByName(extra.join(hot.select(F.col("meet").alias("key")), "key", "left_semi"))
    n = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = settle(member.join(n, "key"))

    reach = F.col("s") * K.TAG_WEIGHT + F.col("c") * K.CATEGORY_WEIGHT
    sure = member.filter(F.col("n") > k).groupBy("pid").agg(F.max(reach).alias("level"))
    kth = top_k(cool, ["pid"], [F.col("score").desc(), F.col("other_pid").asc()], k).filter(F.col("rank") == k)
    level = sure.unionByName(kth.select("pid", F.col("score").alias("level"))).groupBy("pid").agg(F.max("level").alias("level"))
    asked = member.join(level, "pid", "left").withColumn("level", F.coalesce("level", F.lit(0.0)))
    top = F.when(F.col("h") <= 8, MAX_SET).otherwise(2)
    # fewest shared tags that can still reach the level, without and with the category
    least = lambda bonus: F.ceil((F.col("level") - K.KEYWORD_WEIGHT - bonus) / K.TAG_WEIGHT - 1e-9).cast("int")
    lone = asked.withColumn("x0", F.greatest(least(0.0), F.lit(1))).withColumn("x1", F.greatest(least(K.CATEGORY_WEIGHT), F.lit(1)))
    use = F.when(
        F.col("s") == 0, F.col("level") <= F.col("c") * K.CATEGORY_WEIGHT + K.KEYWORD_WEIGHT
    ).when(
        F.col("c") == 0, (F.col("x0") <= F.col("h")) & (F.col("s") == F.least("x0", top))
    ).otherwise(
        (F.col("x1") < F.col("x0")) & (F.col("x1") <= F.col("h")) & (F.col("s") == F.least("x1", top)))
    query = settle(lone.filter(use).select("pid", "key", "n"))

    blocks_of = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    sizes = query.groupBy("key").agg(F.count("*").alias("q"), F.max("n").alias("n")).select(
        "key", blocks_of("q").alias("nq"), blocks_of("n").alias("nm"))
    cut = lambda c: F.pmod(F.xxhash64("pid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ask = query.select("pid", "key").join(sizes, "key").select(
        "pid", "key", F.lit(0).alias("role"), cut("nq").alias("_lo"), every("nm").alias("_hi"))
    answer = member.select("pid", "key").join(sizes, "key").select(
        "pid", "key", F.lit(1).alias("role"), every("nq").alias("_lo"), cut("nm").alias("_hi"))
    cells = attach(profiles, ask.unionByName(answer), "pid", "inner")
    return blocks.run_cells(cells, ["key"], _scorer(k, min_score), SCORED)


def related_docs(
    notes: DataFrame, k: int = K.MAX_LINKS, min_score: float = K.MIN_LINK_SCORE,
    pattern: str = K.CJK_KEYWORD, block_rows: int = 512,
) -> DataFrame:
    """note_name, rank, other_name, score: the k best partners of each note.

    score = 3 x shared tags + 1 for the same category + 0.5 x keyword Jaccard,
    at least ``min_score``; ties by name. Needs columns note_name, tags,
    category, summary.

    Notes equal in tags, category and keywords are folded into one profile that
    keeps its k+1 first names, so copies cost nothing. Two profiles can reach
    ``min_score`` only if they share a tag (or the category, when the limit is
    1.5 or less; or a keyword, at 0.5 or less), so they meet in a group of that
    tag. A group of at most ``block_rows`` profiles is one cell, which keeps
    each profile's k best partners with their true score; larger ones see
    _hot_partners. The k best of the union are exact: a partner outside a
    cell's k best has k better ones there already.
    """
    if min_score <= 0:
        raise ValueError("min_score must be above 0")
    words = F.transform(T.keywords("summary", pattern), lambda w: F.xxhash64(w))
    base = notes.select(
        "note_name",
        F.sort_array(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"),
        F.coalesce(T.nonblank("category"), F.lit(K.DEFAULT_CATEGORY)).alias("category"),
        F.sort_array(F.array_distinct(words)).alias("words"),
    )
    # 128 bits from two independently seeded hashes name a profile
    half = lambda seed: F.hex(F.xxhash64(F.lit(seed), "tags", "category", "words"))
    base = base.withColumn("pid", F.concat_ws("-", half("a"), half("b")))
    base = settle_table(base)  # text is tokenised once; what follows reads hashes and ids
    names = settle(top_k(base.select("pid", "note_name"), ["pid"], [F.col("note_name").asc()], k + 1, "nth"))
    heads = names.filter("nth = 1").select("pid", "note_name")
    one_each = base.join(heads, ["pid", "note_name"])

    meet = F.transform("tags", lambda x: F.concat(F.lit("t"), x))
    if min_score <= K.CATEGORY_WEIGHT + K.KEYWORD_WEIGHT:
        meet = F.concat(meet, F.array(F.concat(F.lit("c"), "category")))
    if min_score <= K.KEYWORD_WEIGHT:
        meet = F.concat(meet, F.transform("words", lambda x: F.concat(F.lit("w"), x.cast("string"))))
    keyed = one_each.select("pid", F.explode(meet).alias("meet"))
    sizes = settle(blocks.group_sizes(keyed, ["meet"], block_rows))
    # groups are found without the words; the wide rows move when each one's cells are known
    found = keyed.join(sizes.filter("_blocks = 1").select("meet"), "meet").groupBy("pid").agg(F.collect_list("meet").alias("cool"))
    profiles = settle_table(base.join(heads.join(found, "pid", "left"), ["pid", "note_name"]).withColumnRenamed("note_name", "first_name"))
    cool = profiles.withColumn("meet", F.explode("cool")).drop("cool").select(
        "*", F.lit(2).alias("role"), F.lit(0).alias("_lo"), F.lit(0).alias("_hi"))
    profiles = profiles.drop("cool")
    scored = settle(
        blocks.run_cells(cool, ["meet"], _scorer(k, min_score), SCORED, pack_rows=128).dropDuplicates(["pid", "other_pid"]))
    hot = sizes.filter("_blocks > 1").select("meet")
    if not hot.isEmpty():
        scored = scored.unionByName(
            _hot_partners(profiles, hot, scored, k, min_score, block_rows)).dropDuplicates(["pid", "other_pid"])

    own = profiles.select(
        "pid", F.col("pid").alias("other_pid"),
        (F.size("tags") * K.TAG_WEIGHT + K.CATEGORY_WEIGHT
         + F.when(F.size("words") > 0, K.KEYWORD_WEIGHT).otherwise(0.0)).alias("score"),
    ).filter(F.col("score") >= min_score)
    partners = scored.unionByName(own).join(
        names.select(F.col("pid").alias("other_pid"), F.col("note_name").alias("other_name")), "other_pid"
    )
    best = top_k(partners, ["pid"], [F.col("score").desc(), F.col("other_name").asc()], k + 1, "nth")
    lists = best.groupBy("pid").agg(
        F.sort_array(F.collect_list(F.struct("nth", "other_name", "score"))).alias("best")
    )
    own_name = F.col("note_name")
    return (
        base.select("note_name", "pid").join(lists, "pid")
        .select("note_name", F.posexplode(F.slice(F.filter("best", lambda s: s["other_name"] != own_name), 1, k)))
        .select("note_name", (F.col("pos") + 1).alias("rank"), F.col("col.other_name").alias("other_name"),
                F.col("col.score").alias("score"))
    )
