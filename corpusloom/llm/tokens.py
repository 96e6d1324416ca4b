"""Token counts: pieces are counted once per distinct pre-token.

A pre-token is a white-space word, with a closing full stop or comma apart. A
task reduces a block of texts to one row per distinct pre-token with the texts
that hold it and how often; distinct pre-tokens of all blocks are encoded once
each; the two are joined on the pre-token and the pieces summed per text. Ids
are never kept. A frequent pre-token has one row per task, and Spark's skew
join cuts such a key further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .vocabulary import plain_words, encoder


#: Text of one block, and of a run of blocks whose rows are merged.
BLOCK_BYTES, RUN_BYTES = 3 << 20, 40 << 20


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, small values short."""
    size = 1 + sum((values >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        on = size > k
        out[at[on] + k] = (values[on] >> (7 * k) & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, size


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, position behind each)."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts))
    return (np.add.reduceat((data & 127).astype(np.int64) << shift, starts) if len(ends) else ends), ends


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.blocks(batches, "text", BLOCK_BYTES):
        words = W.split(plain_words(part.column("text"))).vocabulary.cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([""])])], names=["pretoken"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pretoken, first uid, held) of runs of texts.

    held: for the texts that hold the pre-token the distance of each from the
    one before, then for each how often, as varints. The empty pre-token, which
    no text holds, carries the ids and text sizes of a block.
    """
    pending: list[tuple] = []
    base, size = 0, 0
    for part in W.blocks(batches, "text", BLOCK_BYTES):
        w = W.split(plain_words(part.column("text")))
        uid = part.column("uid").to_numpy()
        facts = pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes")], names=["id", "n_bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, facts.schema) as writer:
            writer.write_batch(facts)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array(uid[:1]), pa.array([sink.getvalue().to_pybytes()])],
                                         names=["pretoken", "base", "held"])
        if not len(w.codes):
            continue
        if not pending:
            base, size = int(uid[0]), 0
        key, times = np.unique(w.codes * len(uid) + W.row_of(w.offsets), return_counts=True)
        word, row = np.divmod(key, len(uid))
        pending.append((w.vocabulary, word.astype(np.int32), (row + (uid[0] - base)).astype(np.int64), times.astype(np.int32)))
        size += pc.sum(part.column("n_bytes")).as_py()
        if size >= RUN_BYTES:
            yield _held(base, pending)
            pending = []
    if pending:
        yield _held(base, pending)


def _held(base: int, pending: list[tuple]) -> pa.RecordBatch:
    """One row per pre-token of several blocks."""
    coded = pa.concat_arrays([v for v, *_ in pending]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    before = np.cumsum([0, *(len(v) for v, *_ in pending)])
    word = np.concatenate([code[lo + w] for lo, (_, w, _, _) in zip(before, pending, strict=False)])
    order = np.argsort(word, kind="stable")  # texts of a word stay in order
    row, times = (np.concatenate([x[i] for x in pending])[order] for i in (2, 3))
    words = len(coded.dictionary)
    count = np.bincount(word, minlength=words)
    first = np.cumsum(count) - count
    step = np.diff(row, prepend=0)
    step[first] = row[first]
    # the steps of a word, then its times
    mixed = np.empty(2 * len(row), np.int64)
    place = np.arange(len(row)) + np.repeat(first, count)
    mixed[place], mixed[place + np.repeat(count, count)] = step, times
    data, size = varints(mixed)
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], 2 * np.cumsum(count)))]
    held = pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.full(words, base)), held],
                                      names=["pretoken", "base", "held"])


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for part in W.blocks(batches, "pretoken"):
            offsets, _ = known.table(part.column("pretoken").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("pretoken"), pa.array(np.diff(offsets))], names=["pretoken", "pieces"])
            known.forget()  # each pre-token comes once

    return run


def _sums(kind: pa.DataType):
    """Pieces per text of the joined rows of one batch; ids (of ``kind``) and sizes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch_sums(batch, kind)

    return run


def _batch_sums(batch: pa.RecordBatch, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        own = pc.equal(batch.column("pretoken"), "")
        names = ["uid", "pieces", "id", "n_bytes"]
        facts = batch.filter(own)
        for base, held in zip(facts.column("base").to_pylist(), facts.column("held"), strict=True):
            block = pa.ipc.open_stream(held.as_buffer()).read_next_batch()
            uid = base + np.arange(block.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.zeros(len(uid), np.int64)), *block.columns], names=names)
        batch = batch.filter(pc.invert(own))
        if not batch.num_rows:
            return
        held = batch.column("held")
        bounds = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1].astype(np.int64)
        values, ends = from_varints(np.frombuffer(held.buffers()[2], np.uint8)[bounds[0]:bounds[-1]])
        cuts = np.searchsorted(ends, bounds - bounds[0], side="right")
        size = np.diff(cuts) // 2
        step, times = values[W.take_ranges(cuts[:-1], size)], values[W.take_ranges(cuts[:-1] + size, size)]
        total = np.cumsum(step)
        start = np.cumsum(size) - size
        uid = total - np.repeat((total[start] - step[start]) - batch.column("base").to_numpy(), size)
        ids, at = np.unique(uid, return_inverse=True)
        pieces = np.repeat(batch.column("pieces").to_numpy(), size) * times
        count = np.bincount(at, weights=pieces, minlength=len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.nulls(len(ids), kind), pa.nulls(len(ids), pa.int64())], names=names)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    ``tokenizer``: path of a word-level ``tokenizers`` file that never joins
    across ASCII white space. Null and empty texts have 0 bytes and 0 tokens.
    Rows that repeat an id or have a null id are counted one by one; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
                      F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    freq = src.mapInArrow(_frequencies, "pretoken string, base long, held binary")
    words = src.select("text").mapInArrow(_vocabularies, "pretoken string").distinct()
    pieces = words.mapInArrow(_pieces(tokenizer), "pretoken string, pieces long")
    kind = src.schema["id"].dataType
    sums = freq.join(pieces, "pretoken").mapInArrow(
        _sums(to_arrow_type(kind)), f"uid long, pieces long, id {kind.simpleString()}, n_bytes long")
    n = F.col("n_tokens")
    return (
        sums.groupBy("uid").agg(F.sum("pieces").alias("n_tokens"), F.any_value("id", ignoreNulls=True).alias(id_col),
                                F.max("n_bytes").alias("n_bytes"))
        .select(id_col, "n_bytes", "n_tokens", (n > limit).alias("over_limit"))
    )
