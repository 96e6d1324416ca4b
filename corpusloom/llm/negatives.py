"""Hard-negative mining with cover trees.

Candidates, ordered by label, are cut into blocks of bounded size, and each
block is one cover tree. Its vectors get one more component that makes all
norms equal, so that a ball around a node's centre (its covering radius in that
space) bounds the inner products of a query with everything below the node.

1. Trees. A node's points are split among centres that lie further apart than
   the level's radius; the first centre is the node's own. Each child keeps the
   distance of its farthest point, and the labels below it. Trees are written
   once and read by both searches.
2. Positives. Anchors visit the blocks that hold their label.
3. Negatives. The scores of an anchor's positives give windows of scores; the
   anchor visits all blocks and passes over nodes that lie outside all windows
   or below what the window has found, or that hold its own label only.

In a tree the nodes are tested level by level for many anchors at once; what is
left is visited best bound first, and the points of a visited leaf are scored
exactly. Only the best few per anchor, or per window, leave a task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank, top_k
from ..session import settle, settle_table
from . import vectors as V

#: Candidates of a tree, anchors of one visit, points of a leaf, points that make a child of their own.
BLOCK, ANCHORS, LEAF, CHILD = 2048, 1024, 48, 8
#: The radius of a level over that of the level above.
SHRINK = 0.8
#: Sums of products are exact below this; larger numbers are Python's.
EXACT = 2.0**53
LONG = 1 << 63

TREE = ("dim int, block long, ids array<long>, labels array<string>, points array<double>, center array<int>, "
        "radius array<double>, parent array<int>, start array<int>, stop array<int>, low array<int>, high array<int>")
FOUND = "anchor_id long, slot int, id long, score long"


class Node(NamedTuple):
    center: int
    radius: float
    parent: int
    start: int
    stop: int


def augmented(points: np.ndarray) -> np.ndarray:
    """The points with a last component that gives all of them the largest norm."""
    square = (points * points).sum(axis=1)
    return np.column_stack((points, np.sqrt(np.maximum(0, square.max(initial=0) - square))))


def build(points: np.ndarray, leaf: int | None = None, child: int | None = None) -> tuple[np.ndarray, list[Node]]:
    """(order of the points, nodes): a node holds points[order[start:stop]].

    Parents come before their children. Points that are too few around their
    centre to be a child form one leaf around the node's own centre.
    """
    leaf, child = leaf or LEAF, child or CHILD
    x = augmented(points)
    order, nodes = np.arange(len(x)), []

    def reach(at, center):
        d = x[at] - x[center]
        far = np.sqrt((d * d).sum(axis=1)).max(initial=0)
        return float(far * (1 + 1e-9) + 1e-9 * np.sqrt((x[center] ** 2).sum()))

    waiting = [(-1, 0, len(x), 0, True)]
    while waiting:
        parent, start, stop, center, splits = waiting.pop()
        at = order[start:stop].copy()
        me, radius = len(nodes), reach(at, center)
        nodes.append(Node(int(center), radius, parent, start, stop))
        if not splits or len(at) <= leaf:
            continue
        square = 2 * ((x[center] ** 2).sum() - x[at] @ x[at].T)
        first = int(np.flatnonzero(at == center)[0])
        level = radius
        while True:  # levels at which the node's own centre covers all are passed over
            level *= SHRINK
            left, own = np.ones(len(at), bool), np.full(len(at), -1)
            centers = [first]
            while left.any():
                c = centers[-1]
                near = left & (square[c] <= level * level)
                near[c] = True
                own[near], left[near] = c, False
                if left.any():
                    centers.append(int(np.flatnonzero(left)[0]))
            if len(centers) > 1 or level <= 1e-6 * radius:
                break
        size = np.bincount(own, minlength=len(at))
        big = [c for c in centers if child <= size[c] < len(at)]
        if not big:
            continue
        pieces = [(c, np.flatnonzero(own == c)) for c in big]
        rest = np.flatnonzero(~np.isin(own, big))
        order[start:stop] = at[np.concatenate([p for _, p in pieces] + [rest])]
        for c, p in pieces:
            waiting.append((me, start, start + len(p), int(at[c]), True))
            start += len(p)
        if len(rest):
            waiting.append((me, start, stop, center, False))
    return order, nodes


def _build_block(scale: int):
    def run(key, rows):
        points = np.floor(scale * V.matrix(rows.column("v").combine_chunks()).astype(np.float64))
        ids, labels = rows.column("id").to_numpy(), rows.column("label").combine_chunks()
        most = np.abs(points).max(initial=0)
        if most * most * max(1, points.shape[1]) < EXACT and points.shape[1]:
            order, nodes = build(points)
        else:  # no bounds on numbers that floats do not hold: one leaf
            order, nodes = np.arange(len(points)), [Node(0, float("inf"), -1, 0, len(points))]
        _, code = np.unique(labels.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = code[order]
        n = list(zip(*nodes, strict=True))
        cols = [key[0].as_py(), key[1].as_py(), ids[order], labels.take(pa.array(order)).to_pylist(), points[order].ravel(),
                place[list(n[0])], n[1], n[2], n[3], n[4], [code[a:b].min() for a, b in zip(n[3], n[4], strict=True)],
                [code[a:b].max() for a, b in zip(n[3], n[4], strict=True)]]
        types = [pa.int32(), pa.int64(), *map(pa.list_, (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), *[pa.int32()] * 5))]
        names = ["dim", "block", "ids", "labels", "points", "center", "radius", "parent", "start", "stop", "low", "high"]
        return pa.table([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


class Tree:
    """A written tree: points in tree order, and its nodes from the root down."""

    def __init__(self, row: pa.Table):
        get = lambda c: row.column(c).combine_chunks().values.to_numpy(zero_copy_only=False)
        self.ids = get("ids")
        self.points = get("points").reshape(len(self.ids), -1)
        self.names, self.code = np.unique(get("labels").astype(str), return_inverse=True)
        self.center, self.radius, self.parent, self.start, self.stop, self.low, self.high = (
            get(c) for c in ("center", "radius", "parent", "start", "stop", "low", "high"))
        self.leaf = np.setdiff1d(np.arange(len(self.parent)), self.parent)
        depth = np.zeros(len(self.parent), np.int64)
        for i in range(1, len(depth)):
            depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        self.most = np.abs(self.points).max(initial=0)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as floats where those are exact."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return a @ b.T
    whole = lambda m: np.vectorize(int, otypes=[object])(m)
    return whole(a) @ whole(b).T


def descend(tree: Tree, q: np.ndarray, own: np.ndarray, label: np.ndarray, ask: np.ndarray, lo: np.ndarray, hi: np.ndarray,
            same: bool, k: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` best points of each ask, -inf where there are fewer.

    Anchors: vectors ``q``, ids ``own``, labels ``label``. Ask i is of anchor
    ``ask[i]`` and takes scores from ``lo[i]`` to ``hi[i]`` of points of the
    anchor's label (``same``) or of the others. ``seen`` collects the number
    of points that were scored.
    """
    exact = np.abs(q).max(initial=0) * tree.most * max(1, q.shape[1]) < EXACT
    kind = np.searchsorted(tree.names, label)
    kind = np.where((kind < len(tree.names)) & (tree.names[np.minimum(kind, len(tree.names) - 1)] == label), kind, -1)[ask]
    norm = np.sqrt((q * q).sum(axis=1))
    alive = np.ones((len(ask), len(tree.parent)), bool)
    bound = np.full((len(ask), len(tree.parent)), np.inf)
    for level in tree.levels:
        if tree.parent[level[0]] >= 0:
            alive[:, level] &= alive[:, tree.parent[level]]
        if same:
            alive[:, level] &= (tree.low[level] <= kind[:, None]) & (kind[:, None] <= tree.high[level])
        else:
            alive[:, level] &= ~((tree.low[level] == kind[:, None]) & (tree.high[level] == kind[:, None]))
        if not exact:
            continue
        some = level[alive[:, level].any(axis=0)]
        mid = q @ tree.points[tree.center[some]].T
        wide = norm[:, None] * tree.radius[some] * (1 + 1e-9) + 1e-6
        bound[:, some] = (mid + wide)[ask]
        alive[:, some] &= (bound[:, some] >= lo[:, None]) & ((mid - wide)[ask] <= hi[:, None])
    order_of = np.where(alive, np.minimum(bound, hi[:, None]), -np.inf)[:, tree.leaf]
    turn = np.argsort(-order_of, axis=1, kind="stable")
    order_of = np.take_along_axis(order_of, turn, axis=1)
    kept = np.full((len(ask), k), -np.inf, object if not exact else float)
    ids = np.full((len(ask), k), np.iinfo(np.int64).max)
    for step in range(len(tree.leaf)):
        going = np.flatnonzero((order_of[:, step] > -np.inf) & (order_of[:, step] >= kept[:, -1]).astype(bool))
        if not len(going):
            break
        for leaf in np.unique(turn[going, step]):
            rows = going[turn[going, step] == leaf]
            a, b = tree.start[tree.leaf[leaf]], tree.stop[tree.leaf[leaf]]
            who, of = np.unique(ask[rows], return_inverse=True)
            score = exact_products(q[who], tree.points[a:b])[of]
            if seen is not None:
                seen.append(len(who) * (b - a))
            fits = ((tree.code[a:b] == kind[rows][:, None]) == same) & (tree.ids[a:b] != own[ask[rows]][:, None])
            fits &= ((score >= lo[rows][:, None]) & (score <= hi[rows][:, None])).astype(bool)
            score = np.where(fits, score, -np.inf)
            both = np.concatenate((kept[rows], score), axis=1)
            names = np.concatenate((ids[rows], np.where(fits, tree.ids[a:b], np.iinfo(np.int64).max)), axis=1)
            if exact:
                best = np.lexsort((names, -both), axis=-1)[:, :k]
            else:
                best = np.array([sorted(range(len(s)), key=lambda i, s=s, n=n: (-s[i], n[i]))[:k] for s, n in zip(both, names, strict=True)])
            kept[rows], ids[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(names, best, axis=1)
    return kept, ids


def _visit(scale: int, k: int, window: tuple[int, int] | None):
    """Positives of a block of anchors in one tree, or negatives in their windows."""

    def run(key, anchors: pa.Table, trees: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if anchors.num_rows and trees.num_rows:
            tree = Tree(trees)
            q = np.floor(scale * V.matrix(anchors.column("v").combine_chunks()).astype(np.float64))
            own = anchors.column("id").to_numpy()
            label = anchors.column("label").to_numpy(zero_copy_only=False).astype(str)
            if window is None:
                ask, slot = np.arange(len(own)), np.zeros(len(own), np.int64)
                lo, hi = np.full(len(own), -np.inf), np.full(len(own), np.inf)
            else:
                scores = anchors.column("scores").combine_chunks()
                ask = np.repeat(np.arange(len(own)), np.diff(scores.offsets.to_numpy()))
                slot = np.arange(len(ask)) - np.repeat(np.flatnonzero(np.diff(ask, prepend=-1)), np.bincount(ask)[np.unique(ask)])
                values = scores.flatten().to_pylist()
                wide = [(-(-window[0] * s // 100), window[1] * s // 100) for s in values]
                kind = float if all(abs(x) < EXACT for w in wide for x in w) else object
                lo, hi = (np.array([w[i] for w in wide], kind) for i in (0, 1))
            score, ids = descend(tree, q, own, label, ask, lo, hi, window is None, k)
            row, col = np.nonzero((score > -np.inf).astype(bool))
            whole = [max(-LONG, min(LONG - 1, int(s))) for s in score[row, col]]
            out = [own[ask[row]], slot[row], ids[row, col], np.array(whole, np.int64)]
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                        names=["anchor_id", "slot", "id", "score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 50 = 0", positives: int = 5, k: int = 3,
                   window: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(``scale`` * x), scores are inner products, higher
    ones first and ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of its label; for each positive come the first
    ``k`` rows of other labels whose score is within ``window`` percent of the
    positive's. A negative positive score has an empty window.

    Rows of null id or label and vectors that are null or hold a null or
    non-finite component (once scaled) take no part; vectors meet those of
    their own length only. An anchor id that is repeated asks once, with its
    smallest vector and label; rows with the anchor's id are not its
    candidates, other repeated ids are candidates each. Scores beyond a long
    are cut to its ends. Other columns are ignored; without anchors,
    positives or rows of other labels the result is empty.
    """
    v = F.col(vector_col)
    src = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.expr(is_anchor).alias("asks"),
        F.transform(v, lambda x: x.cast("double")).alias("v"), F.transform(v, lambda x: x.cast("double") * scale).alias("scaled"))
    rows = src.filter(V.usable("scaled")).select("id", "label", "v", "asks", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("uid"))
    rows = settle_table(rows)
    placed = global_rank(rows.select("dim", "label", "id", "uid"), ["dim", "label", "id", "uid"]).select(
        "uid", F.expr(f"(rn - 1) div {BLOCK}").alias("block"))
    base = rows.select("uid", "id", "label", "v", "dim").join(placed, "uid")
    trees = settle_table(base.groupBy("dim", "block").applyInArrow(_build_block(scale), TREE))
    asked = top_k(rows.filter("asks"), ["id"], [F.col("v").cast("string"), F.col("label"), F.col("uid")], 1, "_once")
    parts = max(1, -(-asked.count() // ANCHORS))
    asked = settle_table(asked.select("id", "label", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("qb")))

    key = ["dim", "qb", "block"]

    def visit(anchors, k, window):
        asks = anchors.select(*[F.col(c).alias(f"of_{c}") for c in key]).distinct()
        needed = trees.join(asks, (F.col("dim") == F.col("of_dim")) & (F.col("block") == F.col("of_block")))
        return anchors.groupBy(*key).cogroup(needed.groupBy(*[f"of_{c}" for c in key])).applyInArrow(_visit(scale, k, window), FOUND)

    best = [F.col("score").desc(), F.col("id")]
    blocks = settle(trees.select("dim", F.expr("block + 0L").alias("block"), F.array_distinct("labels").alias("held")))
    holds = blocks.select("dim", "block", F.explode("held").alias("label"))
    near = visit(asked.join(holds, ["dim", "label"]), positives, None)
    near = settle(top_k(near, ["anchor_id"], best, positives, "place").select("anchor_id", "place", "id", "score"))
    wide = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    far = visit(asked.join(wide, "id").join(blocks.select("dim", "block"), "dim"), k, window)
    far = top_k(far, ["anchor_id", "slot"], best, k)
    chosen = near.select("anchor_id", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(chosen, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
