"""Words of Arrow text columns as numpy arrays, for use inside tasks.

A word is a run of anything but the six ASCII white-space characters, that is
``[^\\x20\\x09-\\x0D]+``. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 3 << 20


class Words(NamedTuple):
    """Words of several texts: text i has codes[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array


def release() -> None:
    """Give freed memory back to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES, max_rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Batches cut where the text passes ``max_bytes``, or after ``max_rows``; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        start = 0
        while start < len(size):
            before = total[start] - size[start]
            stop = min(start + max_rows, max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right"))))
            # a copy: some Arrow functions read slices wrongly
            yield batch if stop - start == len(size) else batch.take(pa.array(np.arange(start, stop)))
            start = stop
            release()


def split(text: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    bounds = np.asarray(lists.offsets)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = flat.filter(full).dictionary_encode()
    return Words(kept[bounds - bounds[0]], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                 coded.dictionary)


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hashes of the words, the same in every process."""
    if not len(vocabulary):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (unsigned arithmetic wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
