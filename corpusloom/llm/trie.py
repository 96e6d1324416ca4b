"""Conversation prefix trie from padded turn-id matrices.

A node at depth d is a distinct sequence of first d turns; a turn's id is the
128-bit hash of its role and text. Conversations are range-sharded by their turn
ids, so a node's members are neighbours, in one shard or at the borders of
several that follow each other.

1. Shard. The ids are dense codes, padded with 0, in matrices of ``COLUMNS``
   turns and as many rows as still have turns (a long conversation pads no
   other). Rows are put in order by lexsort. Where a column changes from one row
   to the next, a node starts there and in all later columns, so the change mask
   is OR-accumulated along the row; reduceat over its starts gives every depth's
   nodes, and reduceat over parents sums up subtrees, deepest first.
2. Border. The nodes on the path of a shard's first and last row may go on in
   the next shard. They come out as partial sums; all others are final.
3. Recombine. Partial sums of a border node add up over its shards. What border
   nodes themselves add to the subtrees above is put on the first path that
   holds them, summed from the end of that path, and added up for each node.

Ids of conversations that end at a border node are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import attach
from ..session import settle, settle_table

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of one matrix, and of one shard on average.
COLUMNS, SHARD_TURNS = 32, 400_000
#: Bytes of a turn: 16 of its id, 4 of its number of words.
TURN = 20
#: Conversation ids hashed at a time.
CHUNK = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

SHARD = ("kind int, shard int, side int, node binary, up binary, depth long, conv_id long, parent_conv_id long, words long, n long, "
         "children long, leaves long, saved long, ends_sha256 string, piece long, ends string")


def turn_code(role: Column, text: Column) -> Column:
    """Bytes that identify a turn, and its number of words; a null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(named, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("bigint")), 8, "0")))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turn codes of each conversation in order, null turns first, ties by code."""
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), turn_code(F.col(role_col), F.col(text_col)).alias("code"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "code"))), lambda x: x["code"]).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 20, longest: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``every`` in place of its own.

    h: crc32 of c in decimal, modulo ``longest``; fewer if there are fewer, none without that conversation.
    """
    head = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    rows = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))).otherwise(F.array().cast("array<binary>"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(head, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))


def _path(ids: np.ndarray) -> list[bytes]:
    """Names of the nodes along one conversation, the root first."""
    h, out = hashlib.sha256(), []
    out.append(h.digest()[:16])
    for turn in ids:
        h.update(turn.tobytes())
        out.append(h.digest()[:16])
    return out


def ordered(convs: np.ndarray, cut: np.ndarray, code: np.ndarray):
    """Put conversations in order and find their nodes.

    Conversation i has the codes ``code[cut[i]:cut[i + 1]]`` (from 1). Returns
    (order, nodes, last): nodes as columns depth, first row, rows, smallest
    conversation, parent, and the position in ``code`` of its last turn; last
    is the node at which each row ends.
    """
    length = np.diff(cut)
    order = np.argsort(convs, kind="stable")
    edge = np.zeros(len(order), bool)  # a row that differs from the one before it so far
    at = np.zeros(len(order), np.int64)  # the node of each row so far: the root
    depths = [np.array([[0], [0], [len(order)], [convs.min()], [-1], [-1]], np.int64)]
    known, start = 1, 0
    while True:
        # rows that just ended are in it too: they pad with zeros and come first
        place = np.flatnonzero(length[order] >= start)
        longest = int(length[order[place]].max(initial=0)) - start if len(place) else 0
        if longest <= 0:
            break
        wide = min(COLUMNS, longest)
        rows, group = order[place], np.cumsum(edge)[place]
        col = start + np.arange(wide)
        inside = col[None, :] < length[rows][:, None]
        matrix = np.zeros((len(rows), wide), code.dtype)
        spot = cut[rows][:, None] + col[None, :]
        matrix[inside] = code[spot[inside]]
        by = np.lexsort((convs[rows], *matrix.T[::-1], group))
        order[place], matrix, spot = rows[by], matrix[by], spot[by]
        rows = order[place]
        change = np.ones((len(rows), wide + 1), bool)
        change[1:, 0] = group[1:] != group[:-1]
        change[1:, 1:] = matrix[1:] != matrix[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(wide):
            starts = np.flatnonzero(change[:, j + 1])
            size = np.diff(np.append(starts, len(rows)))
            smallest = np.minimum.reduceat(convs[rows], starts)
            real = matrix[starts, j] > 0
            first = starts[real]
            own = np.full(len(starts), -1)
            own[real] = known + np.arange(len(first))
            depths.append(np.stack([np.full(len(first), start + j + 1), place[first], size[real], smallest[real], at[place[first]], spot[first, j]]))
            now = np.repeat(own, size)
            at[place[now >= 0]] = now[now >= 0]
            known += len(first)
        edge[place[1:]] |= change[1:, -1]
        start += wide
    return order, np.concatenate(depths, axis=1), at


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    shard = TaskContext.get().partitionId()
    convs, lists = t.column("conv_id").to_numpy(), t.column("turns").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cut = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(cut[0], cut[-1] - cut[0])
    cut = cut - cut[0]
    raw = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(-1, TURN)
    ids = np.ascontiguousarray(raw[:, :16])
    words = np.ascontiguousarray(raw[:, 16:]).view(">u4").ravel().astype(np.int64)
    _, code = np.unique(ids.view("V16").ravel(), return_inverse=True)
    order, nodes, last = ordered(convs, cut, code.astype(np.int32) + 1)
    depth, first, size, smallest, parent, spot = nodes
    count = len(depth)
    words = np.append(words, 0)[spot]
    border = (first == 0) | (first + size == len(order))
    inner = ~border
    children = np.bincount(parent[1:][inner[1:]], minlength=count)
    whole = np.bincount(parent[1:], minlength=count)
    saved = np.where(inner, (size - 1) * words, 0)
    leaves = (inner & (whole == 0)).astype(np.int64)
    level = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
    for d in range(int(depth[-1]), 0, -1):  # nodes of a depth come in the order of their parents
        a, b = level[d], level[d + 1]
        starts = np.flatnonzero(np.diff(parent[a:b], prepend=-1))
        above = parent[a:b][starts]
        saved[above] += np.add.reduceat(saved[a:b], starts)
        leaves[above] += np.add.reduceat(leaves[a:b], starts)

    named: dict[int, bytes] = {}
    sides: dict[int, list[int]] = {}
    for side, row in enumerate((order[0], order[-1])):
        path, node = [], int(last[0 if side == 0 else -1])
        while node >= 0:
            path.append(node)
            node = int(parent[node])
        sides[side] = path[::-1]
        named.update(zip(sides[side], _path(ids[cut[row]:cut[row + 1]]), strict=True))

    # conversations that end at a node are neighbours, in the order of their ids
    ends = convs[order]
    begin = np.flatnonzero(np.diff(last, prepend=-1))
    finals: list = [None] * count
    parts: list[tuple[int, int, str]] = []
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(last)).tolist(), strict=True):
        node = int(last[a])
        if border[node]:
            parts += [(node, lo, ",".join(map(str, ends[lo:min(b, lo + CHUNK)].tolist()))) for lo in range(a, b, CHUNK)]
        else:
            finals[node] = hashlib.sha256(",".join(map(str, ends[a:b].tolist())).encode()).hexdigest()

    def rows(kind, take, side=None, piece=None, text=None):
        n = len(take)
        up = [named.get(int(parent[i])) for i in take]
        known = np.array([u is not None for u in up], bool) | (parent[take] < 0)
        ready = pa.array(smallest[parent[take]], pa.int64(), mask=known) if n else pa.array([], pa.int64())
        longs = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, side or 0, np.int32)),
             pa.array([named.get(int(i)) for i in take], pa.binary()), pa.array(up, pa.binary()), longs(depth[take]), longs(smallest[take]), ready,
             longs(words[take]), longs(size[take]), longs(children[take]), longs(leaves[take]), longs(saved[take]),
             pa.array([finals[i] for i in take], pa.string()), longs(piece if piece is not None else np.zeros(n, np.int64)), pa.array(text or [None] * n, pa.string())],
            names=[c.split()[0] for c in SHARD.split(", ")])

    final = np.flatnonzero(inner)
    for a in range(0, len(final), 50_000):
        yield rows(0, final[a:a + 50_000])
    yield rows(1, np.flatnonzero(border))
    for side, path in sides.items():
        yield rows(2, np.array(path, np.int64), side)
    for a in range(0, len(parts), 64):
        some = parts[a:a + 64]
        yield rows(3, np.array([p[0] for p in some], np.int64), None, np.array([p[1] for p in some], np.int64), [p[2] for p in some])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its pieces, which come in order."""
    node, h = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    yield done()
                node, h = name, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
    if node is not None:
        yield done()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns as by ``conversations``).

    conv_id: smallest member; depth; parent_conv_id: the parent's, null at the
    root; n_convs: members, turnless ones too; n_children; n_leaves: childless
    nodes of its subtree, itself included; saved_tokens: over its subtree, each
    node's members less one, times the words of its last turn; ends_sha256: of
    the ids of members that end there, ascending and joined by commas.

    A repeated conv_id must be merged before. A conversation is a row of ids
    (20 bytes a turn, no texts) in one task; there is no limit on the members of
    a node. Without conversations the result is empty.
    """
    spark = convs.sparkSession
    rows = settle_table(convs.select("conv_id", "turns"))
    total = rows.agg(F.sum(F.size("turns") + 1).alias("t")).first()["t"] or 0
    shards = max(1, -(-total // SHARD_TURNS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 5000))
    out = settle_table(rows.repartitionByRange(shards, "turns", "conv_id").mapInArrow(_shards, SHARD))
    # border nodes: partial sums over the shards
    parts = out.filter("kind = 1").groupBy("node", "up", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    parts = settle(parts)
    below = parts.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("more"))
    full = settle(parts.join(below, "node", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more"))
    # what border nodes add: on the first path that holds them, from there to the root
    path = out.filter("kind = 2").select("node", "depth", F.struct("shard", "side").alias("path"))
    owner = path.groupBy("node").agg(F.min("path").alias("owner"))
    gives = full.join(owner, "node").select("node", F.col("owner").alias("path"), ((F.col("n") - 1) * F.col("words")).alias("gs"), F.when(F.col("children") == 0, 1).otherwise(0).alias("gl"))
    up = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (
        path.join(gives, ["node", "path"], "left")
        .select("node", F.sum(F.coalesce("gs", F.lit(0))).over(up).alias("gs"), F.sum(F.coalesce("gl", F.lit(0))).over(up).alias("gl"))
        .groupBy("node").agg(F.sum("gs").alias("gs"), F.sum("gl").alias("gl"))
    )
    pieces = out.filter("kind = 3").select("node", "shard", "piece", "ends")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = pieces.repartition(tasks, "node").sortWithinPartitions("node", "shard", "piece").mapInArrow(_hash_ends, "node binary, ends_sha256 string")
    edge = settle(full.join(sums, "node").join(hashes, "node", "left").select(
        "node", "up", "depth", "conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), (F.col("leaves") + F.col("gl")).alias("n_leaves"),
        (F.col("saved") + F.col("gs")).alias("saved_tokens"), "ends_sha256"))
    upper = edge.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    border = edge.join(upper, "up", "left").withColumnRenamed("up_conv", "parent_conv_id")
    # inner nodes below a border node take its conversation, by shard: no node's children meet in one task
    inner = out.filter("kind = 0").select(
        "shard", "up", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256")
    here = out.filter("kind = 1").select("shard", F.col("node").alias("up")).join(upper, "up")
    inner = attach(inner, here, ["shard", "up"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return border.select(*cols).unionByName(inner.select(*cols))
