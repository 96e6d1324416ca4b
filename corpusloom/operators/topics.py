"""Topics: centroids, assignment by vector or keywords, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V
from ..plans import blocks
from ..plans.components import components
from ..plans.ranking import group_rank, latest, top_k

# Topics up to this many vector cells are sent to every task as one matrix
# (64 MB of doubles); more are met in cells.
MAX_SHARED_CELLS = 8_000_000


def build_centroids(vecs: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """keys, centroid (unit length), doc_count: the mean direction per group.

    Vectors are summed per dimension with map-side partial sums, so a hot
    group sends one partial vector per task.
    """
    dims = vecs.select(*keys, F.posexplode(V.as_double(vec)).alias("pos", "x"))
    sums = dims.groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    per = sums.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("s"),
        F.max("c").alias("doc_count"))
    mean = F.transform("s", lambda x: x / F.col("doc_count"))
    return per.select(*keys, V.unit(mean).alias("centroid"), "doc_count")


def move_centroids(topics: DataFrame, members: DataFrame) -> DataFrame:
    """Topics after adding member vectors: unit(c * n + sum of vectors).

    topics: topic_id, centroid, doc_count, …; members: topic_id, embedding
    (other dimensions than the centroid's are skipped).
    """
    fit = members.join(topics.select("topic_id", F.size("centroid").alias("_d")), "topic_id").filter(
        F.size("embedding") == F.col("_d"))
    add = fit.select("topic_id", F.posexplode(V.as_double("embedding")).alias("pos", "x")).groupBy(
        "topic_id", "pos").agg(F.sum("x").alias("s"), F.count("*").alias("c")).groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("_s"),
        F.max("c").alias("_c"))
    moved = V.unit(F.zip_with(
        V.as_double("centroid"), "_s", lambda c, s: (c * F.col("doc_count") + s) / (F.col("doc_count") + F.col("_c"))))
    return topics.join(add, "topic_id", "left").withColumn(
        "centroid", F.when(F.col("_c").isNotNull(), moved).otherwise(V.as_double("centroid"))
    ).withColumn("doc_count", F.col("doc_count") + F.coalesce("_c", F.lit(0))).select(*topics.columns)


# ---- assignment by vector ----------------------------------------------------------

def _unit_rows(col) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    m = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(ids, vecs: np.ndarray, tids: np.ndarray, mat: np.ndarray, k: int, lists):
    """Append the k best topics of each vector (ties by topic id)."""
    order = np.argsort(tids, kind="stable")
    tids, mat = tids[order], mat[order]
    sims = vecs @ mat.T
    take = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(vecs)), take.shape[1])
    lists[0].append(ids.take(pa.array(rows)))
    lists[1].append(tids[take.ravel()])
    lists[2].append(sims[rows, take.ravel()])


CAND = "doc_id bigint, topic_id bigint, score double"


def _out(lists):
    if not lists[0]:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(lists[0]), pa.array(np.concatenate(lists[1])), pa.array(np.concatenate(lists[2]))],
        ["doc_id", "topic_id", "score"])


def topic_candidates(vecs: DataFrame, topics: DataFrame, k: int = K.TOPIC_TOP_K, dim: int | None = None,
                     max_shared: int = MAX_SHARED_CELLS, block_rows: int = 4096) -> DataFrame:
    """doc_id, topic_id, score, rank: the k nearest active topics of the same
    level1 and dimension by cosine.

    vecs: doc_id, level1, embedding; topics: topic_id, level1, centroid; with
    ``dim`` only those of that dimension. The size of the topics is checked
    first: few are shared with all tasks and vectors stay where they are; many
    are cut into blocks that meet blocks of vectors.
    """
    def sized(df, ident, vec):
        n = F.size(vec)
        fit = df.filter((n > 0) if dim is None else (n == dim))
        return fit.select(ident, "level1", n.alias("dim"), V.as_double(vec).alias(vec))

    vecs, topics = sized(vecs, "doc_id", "embedding"), sized(topics, "topic_id", "centroid")
    cells = topics.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("n")).first()["n"]
    if cells <= max_shared:
        rows = topics.toArrow()  # at most max_shared numbers
        by_level: dict = {}
        for i, key in enumerate(zip(rows.column("level1").to_pylist(), rows.column("dim").to_pylist())):
            by_level.setdefault(key, []).append(i)
        mats = vecs.sparkSession.sparkContext.broadcast({
            key: (rows.column("topic_id").take(pa.array(at)).to_numpy(), _unit_rows(rows.column("centroid").take(pa.array(at))))
            for key, at in by_level.items()})

        def near(batches):
            for b in batches:
                lists = [[], [], []]
                level = b.column("level1").to_numpy(zero_copy_only=False)
                dims = b.column("dim").to_numpy()
                for key in set(zip(level.tolist(), dims.tolist())):
                    if key not in mats.value:
                        continue
                    at = pa.array(np.flatnonzero((level == key[0]) & (dims == key[1])))
                    tids, mat = mats.value[key]
                    _best(b.column("doc_id").take(at), _unit_rows(b.column("embedding").take(at)), tids, mat, k, lists)
                out = _out(lists)
                if out is not None:
                    yield out

        cand = vecs.mapInArrow(near, CAND)
    else:
        keys = ["level1", "dim"]
        n_lo = vecs.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_nlo"))
        n_hi = topics.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_nhi"))
        size = n_lo.join(n_hi, keys)
        cut = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
        left = vecs.join(size, keys).select(
            *keys, F.lit(0).alias("side"), F.col("doc_id").alias("id"), F.col("embedding").alias("v"),
            cut("doc_id", "_nlo").alias("_lo"), F.explode(F.sequence(F.lit(0), F.col("_nhi") - 1)).alias("_hi"))
        right = topics.join(size, keys).select(
            *keys, F.lit(1).alias("side"), F.col("topic_id").alias("id"), F.col("centroid").alias("v"),
            F.explode(F.sequence(F.lit(0), F.col("_nlo") - 1)).alias("_lo"), cut("topic_id", "_nhi").alias("_hi"))

        def near_cell(t: pa.Table):
            side = t.column("side").to_numpy()
            a, b = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
            if a.num_rows == 0 or b.num_rows == 0:
                return None
            lists = [[], [], []]
            _best(a.column("id").combine_chunks(), _unit_rows(a.column("v")), b.column("id").to_numpy(), _unit_rows(b.column("v")), k, lists)
            return _out(lists)

        cand = blocks.run_cells(left.unionByName(right), keys, near_cell, CAND)
    return top_k(cand, ["doc_id"], [F.col("score").desc(), F.col("topic_id").asc()], k)


def assign_topics(vecs: DataFrame, topics: DataFrame, match: float = K.TOPIC_MATCH,
                  validate: float = K.TOPIC_VALIDATE, **kw) -> DataFrame:
    """doc_id, topic_id, score, decision of every vector.

    match: best score at least ``match``; validate: at least ``validate`` (a
    model or person confirms); new otherwise, without a topic. Centroids are
    those of the start of the batch.
    """
    best = topic_candidates(vecs, topics, 1, **kw).drop("rank")
    r = F.round("score", 12)
    decision = F.when(r >= match, "match").when(r >= validate, "validate").otherwise("new")
    return vecs.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.when(r >= validate, F.col("topic_id")).alias("topic_id"), "score", decision.alias("decision"))


# ---- assignment by keywords ------------------------------------------------------------

def keyword_candidates(docs: DataFrame, topic_keywords: DataFrame, k: int = K.TOPIC_TOP_K) -> DataFrame:
    """doc_id, topic_id, score, rank: matched weight / total weight, above 0.

    docs: doc_id, level1, keywords (array without repeats); topic_keywords:
    topic_id, level1, keyword, weight.
    """
    total = topic_keywords.groupBy("topic_id").agg(F.sum("weight").alias("total"))
    words = docs.select("doc_id", "level1", F.explode("keywords").alias("keyword"))
    got = words.join(topic_keywords, ["level1", "keyword"]).groupBy("doc_id", "topic_id").agg(F.sum("weight").alias("got"))
    scored = got.join(total, "topic_id").select("doc_id", "topic_id", F.try_divide("got", "total").alias("score"))
    return top_k(scored.filter("score > 0"), ["doc_id"], [F.col("score").desc(), F.col("topic_id").asc()], k)


def keyword_topics(docs: DataFrame, topic_keywords: DataFrame, minimum: float = K.TOPIC_KEYWORD) -> DataFrame:
    """Best topic per document with at least ``minimum``."""
    return keyword_candidates(docs, topic_keywords, 1).filter(F.col("score") >= minimum).drop("rank")


def add_members(topics: DataFrame, members: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, members) after keyword assignments: each assignment counts,
    a membership that exists stays as it is; centroids do not move."""
    n = assigned.groupBy("topic_id").agg(F.count("*").alias("_n"))
    counted = topics.join(n, "topic_id", "left").withColumn(
        "doc_count", F.col("doc_count") + F.coalesce("_n", F.lit(0))).select(*topics.columns)
    fresh = latest(assigned.join(members, ["topic_id", "doc_id"], "left_anti"), ["topic_id", "doc_id"], [F.col("score").desc()])
    return counted, members.unionByName(fresh.select(*members.columns))


def add_topics(topics: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed topics not yet known by (name, level1): unit centroid, one
    document, member score 1; of several the first document's."""
    fresh = proposed.join(topics.select("name", "level1"), ["name", "level1"], "left_anti")
    one = latest(fresh, ["name", "level1"], [F.col("doc_id").asc()])
    return one.select(
        "name", "level1", "doc_id", V.unit("embedding").alias("centroid"), F.lit(1).cast("bigint").alias("doc_count"),
        F.lit(1.0).alias("score"))


# ---- merging ------------------------------------------------------------------------------

def merge_pairs(topics: DataFrame, threshold: float = K.TOPIC_MERGE, within_level1: bool = False,
                block_rows: int = 2048) -> DataFrame:
    """a_id, b_id, similarity of topic pairs with cosine >= threshold, a < b."""
    # one group of all topics is keyed by an empty string taken from the id
    grp = F.col("level1") if within_level1 else F.left(F.col("topic_id").cast("string"), F.lit(0))
    t = topics.filter("centroid IS NOT NULL").select("topic_id", grp.alias("grp"), V.as_double("centroid").alias("centroid"))

    def pairs(c: pa.Table):
        block = c.column("_block").to_numpy()
        ids, m = c.column("topic_id").to_numpy(), _unit_rows(c.column("centroid"))
        left = np.flatnonzero(block == c.column("_lo")[0].as_py())
        right = np.flatnonzero(block == c.column("_hi")[0].as_py())
        sims = m[left] @ m[right].T
        i, j = np.nonzero(np.round(sims, 12) >= threshold)
        a, b, s = ids[left[i]], ids[right[j]], sims[i, j]
        keep = a < b if c.column("_lo")[0] == c.column("_hi")[0] else a != b
        a, b, s = a[keep], b[keep], s[keep]
        if len(a) == 0:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a_id", "b_id", "similarity"])

    sized = t.join(blocks.group_sizes(t, ["grp"], block_rows), "grp")
    return blocks.run_cells(blocks.into_cells(sized, "topic_id"), ["grp"], pairs, "a_id bigint, b_id bigint, similarity double")


def merge_topics(topics: DataFrame, members: DataFrame, keywords: DataFrame, pairs: DataFrame):
    """(topics, members, keywords) after merging the pairs; chains end at the
    smallest id. Counts add up, the higher keyword weight and the first
    membership stay, merged topics name their survivor in ``merged_into``."""
    to = components(pairs, "a_id", "b_id").select(F.col("node").alias("topic_id"), F.col("root").alias("_to"))
    move = lambda df: df.join(to, "topic_id", "left").withColumn("topic_id", F.coalesce("_to", "topic_id")).drop("_to")
    tagged = topics.join(to, "topic_id", "left").withColumn("_to", F.coalesce("_to", "topic_id"))
    count = tagged.groupBy(F.col("_to").alias("topic_id")).agg(F.sum("doc_count").alias("_n"))
    out = tagged.join(count, "topic_id", "left").withColumn(
        "status", F.when(F.col("_to") == F.col("topic_id"), "active").otherwise("merged")
    ).withColumn("merged_into", F.when(F.col("_to") != F.col("topic_id"), F.col("_to"))).withColumn(
        "doc_count", F.coalesce("_n", "doc_count")).drop("_to", "_n")
    kept = move(members.withColumn("_was", F.col("topic_id")))
    kept = latest(kept, ["topic_id", "doc_id"], [F.col("_was").asc()]).drop("_was")
    words = move(keywords).groupBy("topic_id", "keyword").agg(F.max("weight").alias("weight"))
    return out, kept, words


def oversized(topics: DataFrame, size: int = K.TOPIC_SPLIT_SIZE) -> DataFrame:
    """Active topics that are due for a split, largest first per level1."""
    return topics.filter((F.col("status") == "active") & (F.col("doc_count") >= size))


def keyword_listing(keywords: DataFrame) -> DataFrame:
    """topic_id, keyword, weight, rank by falling weight."""
    down = keywords.withColumn("_down", -F.col("weight"))
    return group_rank(down, ["topic_id"], ["_down", "keyword"], "rank").select(
        "topic_id", "keyword", "weight", F.col("rank").cast("int").alias("rank"))


def topic_listing(topics: DataFrame) -> DataFrame:
    """Active topics by level1 and falling size."""
    return topics.filter("status = 'active'").orderBy("level1", F.col("doc_count").desc(), "topic_id")
