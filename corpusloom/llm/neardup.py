"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact sets.

1. Sign. Each text's distinct word shingles give BANDS * ROWS minimal hashes.
   Texts with equal sets are one node.
2. Candidates. Nodes that agree in all hashes of a band are a bucket. In each
   bucket the smallest node is the hub, and the candidates are (hub, member).
3. Compare. A candidate's signatures are compared a batch of hashes at a time;
   it goes as soon as the posterior probability of the wanted similarity, given
   the matches so far and a uniform prior, is under the miss probability.
4. Verify. Survivors are confirmed or refused on their full sets.
5. Rest. Members that the links have joined need no pair. If every member that
   is not linked to the hub is, by its posterior bound, more than twice the
   linking distance from it, none of them links to one that is (triangle
   inequality), and those are left out; the hub has met everyone. What still
   holds two components goes through another round with its next hub. When
   rounds stop paying, and for what fits one block, buckets that share nodes
   are put together and cut into blocks, or stay alone where that sends fewer
   rows; each pair of blocks is compared and verified in one task, which sends
   no more links than it has nodes; nothing is capped.

A pair at the threshold misses all 36 bands of 6 hashes with probability 4e-8;
at the first batches and with the default it is dropped at about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import run_cells, task_count
from ..plans.components import components
from ..plans.joins import attach
from ..session import settle, settle_table
from . import words as W
from .jaccard import common_counts, shingle_sets, signatures

BANDS, ROWS = 36, 6
HASHES = BANDS * ROWS
#: Hashes compared between two decisions.
BATCH = 36
MISS = 1e-6
#: Members that one task unit compares with a hub, nodes and shingles of a block, first rows of a block that meet another.
MEMBERS, BLOCK_NODES, BLOCK_SHINGLES, SLICE = 256, 2048, 1 << 20, 16
#: Steps by which buckets that share nodes come together.
JOINED = 3


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(13)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def min_hashes(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of HASHES minimal hashes per set; sets without members get zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for j, (a, b) in enumerate(zip(*_factors(), strict=True)):
            out[full, j] = (np.minimum.reduceat(hashes * a + b, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), 1))
    cells = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x100000001B3) + cells[:, :, r])
    return key


def posterior(matches: int, compared: int, similarity: float) -> float:
    """Probability of at least ``similarity`` after ``matches`` of ``compared`` hashes, prior uniform."""
    n = compared + 1
    return sum(comb(n, i) * similarity**i * (1 - similarity) ** (n - i) for i in range(matches + 1))


def least_matches(similarity: float, miss: float) -> np.ndarray:
    """Matches that a pair needs to go on, after each batch."""
    return np.array([next(m for m in range(n + 1) if posterior(m, n, similarity) >= miss) for n in range(BATCH, HASHES + 1, BATCH)])


def compare(a: np.ndarray, b: np.ndarray, need: np.ndarray, need_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(survives, far) of each pair of rows: batches go on until a pair is far, or to the end."""
    alive, far = np.ones(len(a), bool), np.zeros(len(a), bool)
    matches, going = np.zeros(len(a), np.int64), np.arange(len(a))
    for step, lo in enumerate(range(0, HASHES, BATCH)):
        matches[going] += (a[going, lo:lo + BATCH] == b[going, lo:lo + BATCH]).sum(axis=1)
        alive[going] &= matches[going] >= need[step]
        far[going] = matches[going] < need_far[step]
        going = going[~far[going]]
        if not len(going):
            break
    return alive, far


def _sign_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text"):
            offsets, h = shingle_sets(part.column("text"), width)
            s1, s2 = signatures(offsets, h)
            keys = band_keys(min_hashes(offsets, h))
            bands = W.list_array(np.arange(0, BANDS * (len(keys) + 1), BANDS), keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), bands],
                                             names=["uid", "id", "n", "s1", "s2", "bands"])

    return run


def _body_rows(width: int):
    """Signature and full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text"):
            offsets, h = shingle_sets(part.column("text"), width)
            s1, s2 = signatures(offsets, h)
            sig = min_hashes(offsets, h)
            cuts = np.arange(0, 4 * HASHES * (len(sig) + 1), 4 * HASHES, dtype=np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(cuts), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), body, W.list_array(offsets, h.view(np.int64))],
                                             names=["rep", "n", "s1", "s2", "sig", "tokens"])

    return run


def _matrix(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), HASHES)


def _hub_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows and, for each row, the position of its unit's hub row."""
    hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if hub is not None:
            t = pa.concat_tables([hub, t]).combine_chunks()
        at = np.where(t.column("member").is_null().to_numpy(), np.arange(t.num_rows), 0)
        at = np.maximum.accumulate(at)
        hub = t.take(pa.array([at[-1]]))
        yield t, at


def _judge_rows(need: np.ndarray, need_far: np.ndarray, num: int, den: int):
    """(hub, member, linked, far): signatures in batches, then the full sets of what survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _hub_rows(batches):
            rows = np.flatnonzero(at != np.arange(len(at)))
            if not len(rows):
                continue
            sig, n = _matrix(t.column("sig").combine_chunks()), t.column("n").to_numpy()
            alive, far = compare(sig[rows], sig[at[rows]], need, need_far)
            small, large = np.minimum(n[rows], n[at[rows]]), np.maximum(n[rows], n[at[rows]])
            alive &= den * small >= num * large
            far |= den * small < (2 * num - den) * large
            tokens = t.column("tokens").combine_chunks()
            flat, cut = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            linked = np.zeros(len(rows), bool)
            for i in np.flatnonzero(alive).tolist():
                r, h = int(rows[i]), int(at[rows[i]])
                common = len(np.intersect1d(flat[cut[r]:cut[r + 1]], flat[cut[h]:cut[h + 1]], assume_unique=True))
                linked[i] = den * common >= num * (n[r] + n[h] - common)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([t.column("hub").combine_chunks().take(take), t.column("member").combine_chunks().take(take),
                                              pa.array(linked), pa.array(far)], names=["hub", "member", "linked", "far"])

    return run


def _judged(pairs: DataFrame, bodies: DataFrame, fn) -> DataFrame:
    """``fn`` over units of one hub and up to about MEMBERS of its partners.

    The hub's row comes first in its unit, so a task holds one hub and a batch.
    """
    units = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).filter("parts > 1")
    placed = pairs.join(units, "hub", "left").select("hub", "member", F.coalesce(F.pmod(F.xxhash64("member"), F.col("parts")), F.lit(0)).alias("part"))
    member = placed.join(bodies.withColumnRenamed("nid", "member"), "member").select("hub", "part", "member", "n", "sig", "tokens")
    hub = (placed.select("hub", "part").distinct().join(bodies.withColumnRenamed("nid", "hub"), "hub")
           .select("hub", "part", F.lit(None).cast("long").alias("member"), "n", "sig", "tokens"))
    unit = ["hub", "part"]
    rows = member.unionByName(hub).repartition(task_count(pairs), *unit).sortWithinPartitions(*unit, F.col("member").asc_nulls_first())
    return settle(rows.mapInArrow(fn, "hub long, member long, linked boolean, far boolean"))


def _cell(need: np.ndarray, need_far: np.ndarray, num: int, den: int):
    """Links between two blocks of a bucket that join what is not joined yet, at most one per node.

    Rows of one block meet the other in slices that grow from SLICE rows on:
    what a slice has joined needs no pair in the next ones.
    """

    def run(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        block, n, root = (t.column(c).to_numpy() for c in ("_block", "n", "root"))
        lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if not len(a) or not len(b):
            return None
        sig = _matrix(t.column("sig").combine_chunks())
        tokens = t.column("tokens").combine_chunks()
        flat, cut = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        sets = lambda rows: [flat[cut[r]:cut[r + 1]] for r in rows.tolist()]
        _, of = np.unique(root, return_inverse=True)
        up, out = np.arange(len(root)), []
        start, rows = 0, SLICE
        while start < len(a):
            part, now = a[start:start + rows], up[of]
            fits = now[part][:, None] != now[b][None, :]
            fits &= den * np.minimum(n[part][:, None], n[b][None, :]) >= num * np.maximum(n[part][:, None], n[b][None, :])
            if lo == hi:
                fits &= (start + np.arange(len(part)))[:, None] < np.arange(len(b))[None, :]
            x, y = np.nonzero(fits)
            alive = np.zeros(len(x), bool)
            for at in range(0, len(x), 1 << 14):
                s = slice(at, at + (1 << 14))
                alive[s] = compare(sig[part[x[s]]], sig[b[y[s]]], need, need)[0]
            i, j = part[x[alive]], b[y[alive]]
            start += rows
            rows = max(1, min(2 * rows, (1 << 20) // len(b)))
            if not len(i):
                continue
            (some, at), (others, bt) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            common = common_counts(sets(some), sets(others))[at, bt]
            linked = den * common >= num * (n[i] + n[j] - common)
            for p, q in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                x, y = of[p], of[q]
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                if x != y:
                    up[x] = y
                    out.append((root[p], root[q]))
            while (up[up] != up).any():
                up = up[up]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["hub", "member"])

    return run


def _units(left: DataFrame) -> DataFrame:
    """unit, nid, n: each bucket's nodes meet in a unit, of two ways the one that sends fewer rows.

    Buckets with common nodes take the smallest key among them, JOINED times,
    and those of one key are a group. A group is one unit if, cut into blocks,
    it sends a node no more often than the node has buckets there; otherwise
    each of its buckets is a unit. So rows stay below those of ``left`` unless a
    single bucket takes several blocks.
    """
    rows = left.select("key", "nid", "n", F.col("key").alias("group"))
    for _ in range(JOINED):
        of_node = rows.groupBy("nid").agg(F.min("group").alias("least"))
        of_key = rows.join(of_node, "nid").groupBy("key").agg(F.min("least").alias("group"))
        rows = settle(rows.drop("group").join(of_key, "key"))
    nodes = settle(rows.groupBy("group", "nid").agg(F.max("n").alias("n"), F.count("*").alias("c")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    many = nodes.groupBy("group").agg((blocks * F.count("*") > F.sum("c")).alias("many")).filter("many").select("group")
    return settle(nodes.join(many, "group", "left_anti").select(F.col("group").alias("unit"), "nid", "n").unionByName(
        rows.join(many, "group", "left_semi").select(F.col("key").alias("unit"), "nid", "n")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 85, den: int = 100,
                    miss: float = MISS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two texts link when ``den`` * common >= ``num`` * union of their distinct
    ``width``-word shingles (A-Z lower-cased; a text of fewer words is one
    shingle), which is confirmed on the full sets. component_id: smallest id
    reachable by links, itself included; kept: the id is its component's.
    ``miss``: posterior probability under which a candidate goes.

    Null texts and texts without words have 0 shingles and link with nothing.
    Rows of null id take no part, their component_id and kept are null. Rows
    that repeat an id are one document with several texts, each gets the same
    component. Texts of any length are read whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    need, need_far = least_matches(num / den, miss), least_matches(max(0.0, 2 * num / den - 1), miss)
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = settle_table(src.mapInArrow(_sign_rows(width), "uid long, id long, n long, s1 long, s2 long, bands array<long>"))
    takes = rows.filter("n > 0 and id is not null")
    nodes = settle(takes.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("uid").alias("nid")))
    bands = rows.select(F.col("uid").alias("nid"), "n", "bands").join(nodes.select("nid"), "nid", "left_semi")
    postings = settle_table(bands.select("nid", "n", F.explode("bands").alias("key")))
    buckets = postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    active = settle(postings.join(buckets, "key").select("key", "nid", "n"))
    wanted = settle(nodes.join(active.select("nid").distinct(), "nid"))
    text = attach(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")),
                  wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    full = text.mapInArrow(_body_rows(width), "rep long, n long, s1 long, s2 long, sig binary, tokens array<long>")
    bodies = settle_table(full.join(wanted, ["rep", "n", "s1", "s2"]).select("nid", "n", "sig", "tokens").dropDuplicates(["nid"]))
    judge = _judge_rows(need, need_far, num, den)

    # documents with several texts join the nodes of these
    every = settle(rows.select("uid", "id", "n", "s1", "s2").join(nodes.select("n", "s1", "s2", "nid"), ["n", "s1", "s2"], "left").select("uid", "id", "n", "nid"))
    named = every.filter("nid is not null and id is not null").groupBy("id").agg(F.min("nid").alias("hub"), F.max("nid").alias("top")).filter("hub < top")
    edges = settle(every.join(named.select("id", "hub"), "id").filter("nid <> hub").select("hub", F.col("nid").alias("member")).distinct())

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(root.withColumnRenamed("node", "nid"), "nid", "left").select("key", "nid", "n", F.coalesce("root", "nid").alias("root"))

    known = settle(rows.sparkSession.createDataFrame([], "hub long, member long, linked boolean, far boolean"))
    root = settle(rows.sparkSession.createDataFrame([], "node long, root long"))
    waiting, large = active, active.count()
    small = settle(active.limit(0))
    while large:
        hubs = waiting.groupBy("key").agg(F.min("nid").alias("hub"))
        star = settle(waiting.join(hubs, "key").filter("nid <> hub"))
        pairs = star.select("hub", F.col("nid").alias("member")).distinct()
        found = _judged(settle(pairs.join(known, ["hub", "member"], "left_anti")), bodies, judge)
        known = known.unionByName(found)
        edges = edges.unionByName(found.filter("linked").select("hub", "member"))
        root = components(edges, "hub", "member")
        told = settle(star.join(known.withColumnRenamed("member", "nid"), ["hub", "nid"]).select("key", "nid", "n", "linked", "far"))
        middle = told.groupBy("key").agg(F.max(~F.col("linked") & ~F.col("far")).alias("middle"))
        rest = settle(rooted(told.join(middle, "key").filter("middle or not linked").select("key", "nid", "n")))
        open_ = rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).filter("a < b")
        rest = settle(rest.join(open_.select("key", "c"), "key").select("key", "nid", "n", "c"))
        # what fits one block waits for the cells, larger buckets go on while a round at least halves them
        small = small.unionByName(rest.filter(F.col("c") <= BLOCK_NODES).drop("c"))
        waiting = rest.filter(F.col("c") > BLOCK_NODES).drop("c")
        before, large = large, waiting.count()
        if large > before // 2:
            break
    left = small.unionByName(waiting) if large else small
    if not left.isEmpty():
        unit = _units(left)
        parts = unit.groupBy("unit").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
        block = F.xxhash64("unit", F.pmod(F.xxhash64("nid"), F.col("parts")))
        placed = settle(unit.join(parts, "unit").select("unit", "nid", block.alias("_block"))
                        .join(root.withColumnRenamed("node", "nid"), "nid", "left").select("unit", "nid", "_block", F.coalesce("root", "nid").alias("root")))
        of_block = placed.groupBy("unit", "_block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        one = of_block.select("unit", F.col("_block").alias("_lo"), "low", "high")
        two = of_block.select("unit", F.col("_block").alias("_hi"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        apart = F.least("low", "low2") < F.greatest("high", "high2")
        meets = settle(one.join(two, "unit").filter((F.col("_lo") <= F.col("_hi")) & apart).select("_lo", "_hi"))
        placed = placed.drop("unit")
        sides = placed.join(meets, F.col("_block") == F.col("_lo")).unionByName(
            placed.join(meets.filter("_lo <> _hi"), F.col("_block") == F.col("_hi")))
        more = settle(run_cells(sides.join(bodies, "nid"), [], _cell(need, need_far, num, den), "hub long, member long").distinct())
        # only the roots of what is joined already meet again
        top = components(more, "hub", "member").select(F.col("node").alias("root"), F.col("root").alias("top"))
        lone = top.select(F.col("root").alias("node")).join(root.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
        root = settle(root.unionByName(lone).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    elif not large and active.isEmpty() and not edges.isEmpty():
        root = components(edges, "hub", "member")
    label = nodes.select("nid", "rep").join(root.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "rep", F.coalesce("root", "nid").alias("root"))
    label = settle(label)
    first = label.groupBy("root").agg(F.min("rep").alias("component"))
    of_id = every.join(label.join(first, "root").select("nid", "component"), "nid").groupBy("id").agg(F.min("component").alias("component"))
    out = every.select("id", "n").join(of_id, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
                      (F.col("id") == F.coalesce("component", "id")).alias("kept"))

