"""Keyed state of the streams, kept by the engine's state store.

Each processor handles one key at a time. What one key may hold too many rows
of is read as a stream (``FirstSeen``) or kept as 17 bytes a row (``Streaks``,
``Rests``), so the micro-batch bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K


class FirstSeen(StatefulProcessor):
    """The rows of a content in the first micro-batch that has it: the smallest path, or all of them."""

    def __init__(self, one: bool):
        self.one = one

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at_batch boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        if self.one:
            paths = [None]
            for r in rows:
                if r["path"] is not None and (paths[0] is None or r["path"] < paths[0]):
                    paths[0] = r["path"]
        else:
            paths = (r["path"] for r in rows)
        for path in paths:
            yield Row(md5=key[0], path=path, status="success")


KINDS = list(K.COOLDOWN)
OTHER, OK = len(KINDS), len(KINDS) + 1


def ordered_calls(parts: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ts in microseconds, seq, outcome code) of one provider's calls in time order."""
    code = {**{k: i for i, k in enumerate(KINDS)}, "ok": OK}
    at, seq, kind = [], [], []
    for p in parts:
        at.append(p["at"].to_numpy(np.int64))
        seq.append(p["seq"].to_numpy(np.int64))
        kind.append(p["outcome"].map(code).fillna(OTHER).to_numpy(np.int8))
    at, seq, kind = np.concatenate(at), np.concatenate(seq), np.concatenate(kind)
    order = np.lexsort((seq, at))
    return at[order], seq[order], kind[order]


def running(kind: np.ndarray, carried: tuple[int, ...]) -> list[np.ndarray]:
    """For each kind, how many calls of it came since the last success."""
    ok = np.maximum.accumulate(np.where(kind == OK, np.arange(len(kind)), -1))
    out = []
    for k, before in enumerate(carried):
        total = np.cumsum(kind == k)
        out.append(total - np.where(ok >= 0, total[ok], -before))
    return out


def rest_seconds(kind: np.ndarray, streaks: list[np.ndarray], limit: int, rules: dict) -> np.ndarray:
    out = np.zeros(len(kind), np.int64)
    for k, (short, long) in enumerate(rules.values()):
        out = np.where(kind == k, np.where(streaks[k] >= limit, long, short), out)
    return out


class Streaks(StatefulProcessor):
    """Each call with its provider's running failure streaks and the rest it causes."""

    def __init__(self, limit: int = K.STREAK_LIMIT, rules: dict = K.COOLDOWN):
        self.limit, self.rules = limit, rules

    def init(self, handle) -> None:
        self.streaks = handle.getValueState("streaks", ", ".join(f"{k} bigint" for k in KINDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        carried = self.streaks.get() or (0,) * len(KINDS)
        at, seq, kind = ordered_calls(rows)
        counts = running(kind, carried)
        self.streaks.update(tuple(int(c[-1]) for c in counts))
        rest = rest_seconds(kind, counts, self.limit, self.rules)
        for lo in range(0, len(at), 10_000):
            s = slice(lo, lo + 10_000)
            yield pd.DataFrame({"provider": key[0], "at": at[s], "seq": seq[s], "kind": kind[s].astype(np.int32),
                                **{k: c[s] for k, c in zip(KINDS, counts, strict=True)}, "cooldown": rest[s].astype(np.int32)})


class Rests(StatefulProcessor):
    """Finished rests of a provider.

    A rest starts with a failure while the provider is available, each further
    failure sets its end anew, and it ends with a success or, when the
    watermark reaches the end, by timer.
    """

    def __init__(self, limit: int = K.STREAK_LIMIT, rules: dict = K.COOLDOWN):
        self.limit, self.rules = limit, rules

    def init(self, handle) -> None:
        self.handle = handle
        self.streaks = handle.getValueState("streaks", ", ".join(f"{k} bigint" for k in KINDS))
        self.rest = handle.getValueState("rest", "start bigint, until bigint, failures bigint")

    def _row(self, key, start: int, end: int, failures: int, by: str) -> tuple:
        return key[0], start, end, failures, by

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["provider", "start", "finish", "failures", "ended_by"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        carried = self.streaks.get() or (0,) * len(KINDS)
        at, _, kind = ordered_calls(rows)
        counts = running(kind, carried)
        self.streaks.update(tuple(int(c[-1]) for c in counts))
        until = (at // 1_000_000 + rest_seconds(kind, counts, self.limit, self.rules)) * 1_000_000
        before = self.rest.get()
        open_, out = before, []
        for i in np.flatnonzero(kind != OTHER).tolist():
            now = int(at[i])
            if open_ is not None and open_[1] <= now:
                out.append(self._row(key, *open_[:2], open_[2], "timer"))
                open_ = None
            if kind[i] == OK:
                if open_ is not None:
                    out.append(self._row(key, open_[0], now, open_[2], "success"))
                open_ = None
            else:
                open_ = (open_[0] if open_ else now, int(until[i]), (open_[2] if open_ else 0) + 1)
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        if before is not None and (open_ is None or open_[1] != before[1]):
            self.handle.deleteTimer(before[1] // 1000)
        if open_ is None:
            self.rest.clear()
        else:
            self.rest.update(open_)
            if before is None or open_[1] != before[1]:
                self.handle.registerTimer(open_[1] // 1000)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self.rest.get()
        if open_ is not None and open_[1] // 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.rest.clear()
            yield self._frame([self._row(key, *open_[:2], open_[2], "timer")])
