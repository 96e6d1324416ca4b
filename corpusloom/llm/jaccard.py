"""N-gram Jaccard join: grouped prefix join over word shingles.

Texts with the same shingle set are one node. Two nodes of sizes a and b with
Jaccard similarity t or more share at least ceil(t (a + b) / (1 + t)) shingles.

1. Screen. Of its first a - ceil(t a) + 1 + a // 10 shingles in hash order, a
   text shares at least 1 + ceil(t a) // 10 with any partner. A text with fewer
   shingles there that occur anywhere else links with nothing. A block of texts
   sends a shingle it holds several times once, so no shingle is a hot key.
2. Prefix. Of the remaining nodes (few), each keeps the rarest
   a - ceil(t a) + 1 shingles; those without a second holder join nothing.
3. Group. Nodes with the same size and kept prefix are one group. Groups that
   share a kept shingle go to the family of the most popular group among them
   (a hub), families are cut into blocks of bounded size, and only pairs of
   blocks that share a kept shingle and fit in size go on.
4. Expand and verify. A task gets the sets of two blocks, counts all common
   shingles exactly and sends one row per linked node, not one per pair.

Shingles are compared by 64-bit hashes, sets are folded by 128 bits and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import task_count
from ..plans.components import components
from ..plans.joins import attach
from ..plans.ranking import top_k
from ..session import settle, settle_table
from . import words as W

#: Share of further shingles that the screen looks at: 1 in EXTRA.
EXTRA = 10
BLOCK_NODES, BLOCK_SHINGLES = 128, 1 << 18
#: Ranges of token hashes, and the row number that stands for several texts of a block.
RANGES, SEVERAL = 2048, 0xFFFF


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (offsets, hashes)."""
    w = W.split(pc.ascii_lower(text))
    x = W.hashes(w.vocabulary)[w.codes]
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
    size = np.diff(w.offsets)
    wide = np.zeros(max(0, len(x) - width + 1), np.uint64)
    for i, f in enumerate(factors):
        wide += x[i:i + len(wide)] * f
    wide = W.mix(wide)
    sets = []
    for start, n in zip(w.offsets[:-1].tolist(), size.tolist(), strict=True):
        if n >= width:
            s = np.sort(wide[start:start + n - width + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:  # the whole sequence is the one shingle
            one = (x[start:start + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(W.mix(W.mix(np.array([one], np.uint64))))
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return offsets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set that do not depend on order."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(hashes ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _ranges(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of ``columns`` in each range of ``part``."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    which, first = np.unique(part[order], return_index=True)
    columns = [c[order] for c in columns]
    for r, lo, hi in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        yield r, [c[lo:hi] for c in columns]


def _pack(token: np.ndarray, row: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(range, body) of the tokens of a block: six bytes for a token and its row."""
    out = [(r, c.tobytes() + d.tobytes()) for r, (c, d) in _ranges(
        (token >> np.uint64(53)).astype(np.int32), (token >> np.uint64(21)).astype(np.uint32), row.astype(np.uint16))]
    return [r for r, _ in out], [body for _, body in out]


def _unpack(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rows, tokens of each body) of several bodies, one after another."""
    size = np.array([len(x) // 6 for x in bodies], np.int64)
    codes = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(bodies, size.tolist(), strict=True)])
    return codes, np.concatenate([np.frombuffer(x, np.uint16, n, 4 * n) for x, n in zip(bodies, size.tolist(), strict=True)]), size


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of all neighbouring rows with the same key; rows come sorted by it."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if waiting and waiting[0].column(key)[0].as_py() != k[0]:
            yield pa.concat_tables(waiting)
            waiting = []
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            yield pa.concat_tables([*waiting, t.slice(lo, hi - lo)])
            waiting = []
        waiting.append(t.slice(cuts[-2]))
    if waiting:
        yield pa.concat_tables(waiting)


SCREEN = "range int, block long, uid long, id long, n long, s1 long, s2 long, need long, more long, body binary"
MET = SCREEN.partition(", ")[2]
TEXTS = MET.partition(", ")[2].rpartition(", ")[0]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _screen_rows(num: int, den: int, width: int):
    """A row per text with what its block knows, and one per block and range of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text", max_rows=SEVERAL):
            offsets, h = shingle_sets(part.column("text"), width)
            s1, s2 = signatures(offsets, h)
            n = np.diff(offsets)
            take = np.where(n > 0, np.minimum(n, prefix_length(n, num, den) + n // EXTRA), 0)
            need = 1 + -(-num * n // den) // EXTRA  # 1 + r of the smallest partner
            pos = W.take_ranges(offsets[:-1], take)
            token, row = h[pos], np.repeat(np.arange(len(n)), take)
            distinct, first, count = np.unique(token, return_inverse=True, return_counts=True)
            many = count[first] > 1
            known = np.bincount(row[many], minlength=len(n))
            uid = part.column("uid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array((uid % RANGES).astype(np.int32)), pa.array(np.full(len(n), uid[0])), part.column("uid"), part.column("id"), pa.array(n),
                 pa.array(s1), pa.array(s2), pa.array(need), pa.array(known), pa.nulls(len(n), pa.binary())], names=_names(SCREEN))
            own = distinct[count > 1]
            at = np.concatenate(((uid[row[~many]] - uid[0]), np.full(len(own), SEVERAL)))
            ranges, bodies = _pack(np.concatenate((token[~many], own)), at)
            none = pa.nulls(len(ranges), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), pa.array(np.full(len(ranges), uid[0])), none, none, none, none, none, none, none,
                 pa.array(bodies, pa.binary())], names=_names(SCREEN))

    return run


def _met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the texts, and for each block how many tokens of its texts other blocks hold too."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for t in _by(batches, "range"):
        lone = pc.is_null(t.column("body"))
        yield from t.filter(lone).select(_names(MET)).combine_chunks().to_batches()
        t = t.filter(pc.invert(lone))
        if not t.num_rows:
            continue
        codes, row, size = _unpack(t.column("body").to_pylist())
        _, first, count = np.unique(codes, return_inverse=True, return_counts=True)
        met = (count[first] > 1) & (row != SEVERAL)
        waiting.append((np.repeat(t.column("block").to_numpy(), size)[met], row[met]))
        if sum(len(r) for _, r in waiting) > 1 << 19:
            yield _per_block(waiting)
            waiting = []
    if waiting:
        yield _per_block(waiting)
    W.release()


def _per_block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per block: how often each of its rows occurs."""
    block, row = (np.concatenate(c) for c in zip(*parts, strict=True))
    which, code = np.unique(block, return_inverse=True)
    at, count = np.unique(code * (SEVERAL + 1) + row, return_counts=True)
    cells = _ranges(at // (SEVERAL + 1), count.astype(np.uint32), (at % (SEVERAL + 1)).astype(np.uint16))
    bodies = [c.tobytes() + r.tobytes() for _, (c, r) in cells]
    none = pa.nulls(len(which), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(which), none, none, none, none, none, none, none, pa.array(bodies, pa.binary())], names=_names(MET))


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block with the number of their tokens that are met again."""
    for t in _by(batches, "block"):
        lone = pc.is_null(t.column("body"))
        texts, counts = t.filter(lone), t.filter(pc.invert(lone))
        more = texts.column("more").to_numpy().copy()
        if counts.num_rows:
            times, row, _ = _unpack(counts.column("body").to_pylist())
            found = np.bincount(row, times, minlength=SEVERAL).astype(np.int64)
            more += found[texts.column("uid").to_numpy() - texts.column("block").to_numpy()]
        out = texts.select(_names(TEXTS)[:-1]).append_column("more", pa.array(more))
        yield from out.combine_chunks().to_batches()


def _full_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text"):
            offsets, h = shingle_sets(part.column("text"), width)
            s1, s2 = signatures(offsets, h)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2),
                 W.list_array(offsets, h.view(np.int64))], names=["rep", "n", "s1", "s2", "tokens"])

    return run


HELD = "range int, block long, body binary"
PREFIXES = "nid long, n long, prefix array<long>, pop double"


def _held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of sets a row with its nodes (range -1), and its tokens by range."""
    for batch in batches:
        size = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size), 0
        while start < len(size):
            stop = int(np.searchsorted(total, total[start] - size[start] + BLOCK_SHINGLES, side="right"))
            stop = min(max(start + 1, stop), start + SEVERAL)
            part = batch.slice(start, stop - start)
            token = part.column("tokens").flatten().to_numpy().view(np.uint64)
            nodes = np.stack([part.column(c).to_numpy() for c in ("nid", "n")]).astype(np.int64)
            ranges, bodies = _pack(token, np.repeat(np.arange(stop - start), size[start:stop]))
            block = np.full(len(ranges) + 1, part.column("uid")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *ranges], pa.int32()), pa.array(block), pa.array([nodes.tobytes(), *bodies], pa.binary())],
                names=["range", "block", "body"])
            start = stop


def _frequent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_held_rows`` without what one node alone holds, with two more bytes for the holders of a token."""
    for rows in _by(batches, "range"):
        if rows.column("range")[0].as_py() < 0:
            yield from rows.combine_chunks().to_batches()
            continue
        codes, row, size = _unpack(rows.column("body").to_pylist())
        _, first, count = np.unique(codes, return_inverse=True, return_counts=True)
        df = np.minimum(count[first], 0xFFFF).astype(np.uint16)
        ends = np.cumsum(size)
        keep = [lo + np.flatnonzero(df[lo:hi] > 1) for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        bodies = [codes[k].tobytes() + row[k].tobytes() + df[k].tobytes() if len(k) else None for k in keep]
        out = rows.select(["range", "block"]).append_column("body", pa.array(bodies, pa.binary()))
        yield from out.filter(pc.is_valid(out.column("body"))).combine_chunks().to_batches()


def _prefix_rows(num: int, den: int):
    """PREFIXES of the nodes of each block: their rarest tokens that others hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by(batches, "block"):
            ranges, bodies = t.column("range").to_numpy(), t.column("body").to_pylist()
            head = int(np.flatnonzero(ranges < 0)[0])
            nid, n = np.frombuffer(bodies[head], np.int64).reshape(2, -1)
            parts = [(r, x) for r, x in zip(ranges.tolist(), bodies, strict=True) if r >= 0]
            if not parts:
                continue
            size = [len(x) // 8 for _, x in parts]
            take = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for (_, x), k in zip(parts, size, strict=True)])  # noqa: B023, E731
            token = (np.repeat([r for r, _ in parts], size).astype(np.int64) << 32) | take(np.uint32, 0).astype(np.int64)
            row, df = take(np.uint16, 4).astype(np.int64), take(np.uint16, 6).astype(np.int64)
            order = np.lexsort((token, df, row))
            shared = np.bincount(row, minlength=len(nid))
            keep = np.minimum(np.maximum(0, prefix_length(n, num, den) - (n - shared)), shared)
            pos = W.take_ranges((np.cumsum(shared) - shared)[keep > 0], keep[keep > 0])
            pop = np.bincount(row, df - 1, minlength=len(nid)) / n
            yield pa.RecordBatch.from_arrays(
                [pa.array(nid[keep > 0]), pa.array(n[keep > 0]),
                 W.list_array(np.concatenate(([0], np.cumsum(keep[keep > 0]))), token[order][pos]), pa.array(pop[keep > 0])],
                names=["nid", "n", "prefix", "pop"])
        W.release()

    return run


def linked(m: np.ndarray) -> np.ndarray:
    """Smallest row number that each row of a symmetric link matrix reaches."""
    label = np.arange(len(m))
    while True:
        near = np.where(m, label[None, :], len(m)).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact number of common values of each set in ``a`` with each in ``b``."""
    ca, cb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ca, cb)
    out = np.zeros((len(a), len(b)))

    def place(values, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(both, values)
        ok = col < len(both)
        ok[ok] = both[col[ok]] == values[ok]
        return row[ok], col[ok]

    (ra, xa), (rb, xb) = place(ca, a), place(cb, b)
    for lo in range(0, len(both), columns):
        parts = []
        for r, x, size in ((ra, xa, len(a)), (rb, xb, len(b))):
            inside = (x >= lo) & (x < lo + columns)
            m = np.zeros((size, min(columns, len(both) - lo)), np.float32)
            m[r[inside], x[inside] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def _verify(num: int, den: int):
    def one(members: dict, same: bool):
        nid, n, copies, left, sets = members
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        if not len(a) or not len(b):
            return None
        common = common_counts([sets[i] for i in a], [sets[i] for i in b])
        link = (num + den) * common >= num * (n[a][:, None] + n[b][None, :])
        link &= nid[a][:, None] != nid[b][None, :]
        full = np.zeros((len(nid), len(nid)), bool)
        full[np.ix_(a, b)] = link
        full |= full.T
        has = np.flatnonzero(full.any(axis=1))
        return nid[has], nid[linked(full)[has]], (full[has] * copies[None, :]).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_pylist()
            cells = batch.column("members")
            out = []
            for i in range(len(cells)):
                m = cells[i].values
                order = np.argsort(m.field("nid").to_numpy(), kind="stable")
                nid = m.field("nid").to_numpy()[order]
                left = m.field("left").to_numpy(zero_copy_only=False)[order]
                once = np.concatenate(([True], nid[1:] != nid[:-1]))
                order, left = order[once], left[once]
                tokens = m.field("tokens")
                sets = [tokens[int(j)].values.to_numpy() for j in order]
                got = one((nid[once], m.field("n").to_numpy()[order], m.field("copies").to_numpy()[order], left, sets),
                          same[i])
                if got is not None and len(got[0]):
                    out.append(got)
            if out:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["nid", "near", "links"])
            W.release()

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75,
                 den: int = 100) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_links.

    Two texts link when ``den`` * common >= ``num`` * union of their distinct
    ``width``-word shingles (A-Z lower-cased; a text of fewer words is one
    shingle). component_id: smallest id reachable by links, itself included;
    n_links: number of other rows with a linked text, exact copies included.
    Texts without words, and null texts, have 0 shingles and link with
    nothing. Rows of null id take no part and have a null component_id. Rows
    that repeat an id count as one document with several texts. Other columns
    are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"),
                      F.col(text_col).alias("text"))
    # tokens meet by ranges of their hashes, so no token and no text is a key
    met = src.mapInArrow(_screen_rows(num, den, width), SCREEN).repartition(task_count(docs), "range").sortWithinPartitions("range")
    met = met.mapInArrow(_met_rows, MET).repartition(task_count(docs), "block").sortWithinPartitions("block")
    rows = settle_table(met.mapInArrow(_text_rows, TEXTS))
    all_docs = rows.select("uid", "id", "n", "s1", "s2")
    alive = rows.filter("n > 0 and id is not null and more >= need").select("n", "s1", "s2").distinct()
    nodes = (
        all_docs.filter("n > 0 and id is not null").groupBy("n", "s1", "s2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    nodes = settle(nodes.withColumn("nid", F.xxhash64("n", "s1", "s2")))
    cand = settle(nodes.join(alive, ["n", "s1", "s2"], "left_semi"))

    text = attach(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")),
                  cand.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    full = text.mapInArrow(_full_rows(width), "rep long, n long, s1 long, s2 long, tokens array<long>")
    sets = settle_table(attach(full, cand, ["rep", "n", "s1", "s2"], "inner").select("nid", "n", "copies", "tokens"))

    held = sets.select(F.monotonically_increasing_id().alias("uid"), "nid", "n", "tokens").mapInArrow(_held_rows, HELD)
    # the rows of nodes are spread, the others meet by range
    held = held.repartition(task_count(docs), "range", F.when(F.col("range") < 0, F.col("block"))).sortWithinPartitions("range")
    held = held.mapInArrow(_frequent_rows, HELD).repartition(task_count(docs), "block").sortWithinPartitions("block")
    kept = settle_table(held.mapInArrow(_prefix_rows(num, den), PREFIXES))
    return _finish(all_docs, nodes, sets, kept, num, den, id_col)


def _finish(all_docs, nodes, sets, kept, num, den, id_col) -> DataFrame:
    kept = kept.withColumn("gid", F.xxhash64("n", "prefix"))
    groups = settle_table(kept.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.max("pop").alias("pop")))
    post = groups.select("gid", "n", "pop", F.explode("prefix").alias("token"))
    hub = post.groupBy("token").agg(F.max(F.struct("pop", "gid")).alias("hub"))
    family = post.join(hub, "token").groupBy("gid").agg(F.max("hub").alias("hub")).select("gid", F.col("hub.gid").alias("family"))
    member = settle(kept.select("nid", "n", "gid").distinct().join(family, "gid").select("nid", "n", "gid", "family"))
    parts = member.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = settle(
        member.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")))
        .select("nid", "n", "gid", F.xxhash64("family", "part").alias("block"))
    )
    # group pairs, as pairs of the blocks their members lie in
    spot = (
        post.select("gid", "token").join(placed.groupBy("gid", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "gid")
        .groupBy("token", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    a = spot.select("token", F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    b = spot.select("token", F.col("block").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    fits = (F.col("xlo") * num <= F.col("yhi") * den) & (F.col("ylo") * num <= F.col("xhi") * den)
    cells = settle(a.join(b, "token").filter((F.col("x") <= F.col("y")) & fits).select("x", "y").distinct())
    spots = placed.select("nid", "block")
    meets = (
        spots.join(cells.select(F.col("x").alias("block"), "x", "y"), "block").withColumn("left", F.lit(True))
        .unionByName(spots.join(cells.filter("x <> y").select(F.col("y").alias("block"), "x", "y"), "block").withColumn("left", F.lit(False)))
    )
    row = F.struct("nid", "n", "copies", "left", "tokens")
    found = settle(
        attach(sets, meets.select("nid", "x", "y", "left"), "nid", "inner").groupBy("x", "y").agg(F.collect_list(row).alias("members"))
        .select((F.col("x") == F.col("y")).alias("same"), "members")
        .mapInArrow(_verify(num, den), "nid long, near long, links long")
    )
    rep = nodes.select("nid", "rep", "copies")
    edges = (
        found.select("nid", "near").distinct().join(rep.select("nid", F.col("rep").alias("a")), "nid")
        .join(rep.select(F.col("nid").alias("near"), F.col("rep").alias("b")), "near").select("a", "b")
    )
    root = components(edges, "a", "b")
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    known = (
        nodes.join(links, "nid", "left").join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("n", "s1", "s2", F.coalesce("root", "rep").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        all_docs.join(known, ["n", "s1", "s2"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id")).alias("component_id"),
            F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        )
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that link to a smaller id.

    One document of each component stays, with all its columns: the smallest
    id, and of rows that repeat it the one with the smallest text. Rows of null
    id stay.
    """
    found = jaccard_join(docs, id_col, text_col, **options)
    by_id = settle(
        found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.min("component_id").alias("root"), F.count("*").alias("rows")).filter("root <> id or rows > 1")
    )
    name = f"_{id_col}_linked"
    gone = by_id.filter("root <> id").select(F.col("id").alias(name))
    again = by_id.filter("root = id").select(F.col("id").alias(name))
    rest = attach(docs.withColumn(name, F.col(id_col).cast("bigint")), gone, name, "left_anti")
    if again.isEmpty():
        return rest.drop(name)
    once = top_k(attach(rest, again, name, "left_semi"), [name], [F.col(text_col)], 1, f"{name}_rank").drop(f"{name}_rank")
    return attach(rest, again, name, "left_anti").unionByName(once).drop(name)
