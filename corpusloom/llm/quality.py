"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded
from word shapes, marks, case, lengths and repetition; gated attention, learned
from document labels, weighs the encodings, and the weighted sum is scored. The
weights are fitted on the driver over a bounded sample; scoring runs over all
documents in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .fit import held_out, sample

PASSAGE = 64
SHAPES = 24
#: Labelled documents of a class that are fitted, with all their passages.
PER_CLASS = 4000
LAGS = ((1, 2), (2, 8), (8, 33))
WIDTH = 9 + len(LAGS) + SHAPES


def _word_features(vocabulary: pa.Array) -> np.ndarray:
    """Features of each distinct word."""
    n = len(vocabulary)
    if not n:
        return np.zeros((0, 9 + SHAPES), np.float32)
    text = vocabulary.cast(pa.large_string())
    has = lambda pattern: pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    out = np.zeros((n, 9 + SHAPES), np.float32)
    out[:, 0] = has(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
    out[:, 1] = has(r"[^\p{L}\p{N}.,;:'!?\"()-]")
    out[:, 2] = has(r"[!?]{2}")
    out[:, 3] = ~has(r"[\p{L}\p{N}]")
    out[:, 4] = has(r"\p{N}")
    out[:, 5] = has(r"[.!?][\"')]*$")
    out[:, 6] = has(r"^\p{Lu}")
    out[:, 7] = np.log1p(length)
    out[:, 8] = np.log1p(length) ** 2
    shape = text
    for pattern, mark in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "9"), (r"([^aA9])[^aA9]+", r"\1\1")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    coded = shape.dictionary_encode()
    bucket = (W.hashes(coded.dictionary) % np.uint64(SHAPES)).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    out[np.arange(n), 9 + bucket] = 1
    return out


def passages(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each text, features); a text without words has one of zeros."""
    w = W.split(text)
    size = np.diff(w.offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((bag[-1], WIDTH), np.float32)
    if len(w.codes):
        row = W.row_of(w.offsets)
        place = np.arange(len(w.codes)) - w.offsets[:-1][row]
        at = bag[:-1][row] + place // PASSAGE
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        which, words = at[starts], np.diff(np.append(starts, len(at))).astype(np.float32)
        per_word = _word_features(w.vocabulary)
        for j in range(per_word.shape[1]):
            out[which, len(LAGS) + j] = np.add.reduceat(per_word[w.codes, j], starts) / words
        for j, (lo, hi) in enumerate(LAGS):
            again = np.zeros(len(w.codes), bool)
            for lag in range(lo, hi):
                again[lag:] |= (w.codes[lag:] == w.codes[:-lag]) & (place[lag:] >= lag) if lag < len(again) else False
            out[which, j] = np.add.reduceat(again.astype(np.float32), starts) / words
    return bag, out


class AttentionModel:
    """Gated attention over passage encodings, fitted by Adam."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.p = {"w": draw(width, hidden), "b": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate),
                  "a": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["a"]
        row = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(s - np.maximum.reduceat(s, bag[:-1])[row])
        att = e / np.add.reduceat(e, bag[:-1])[row]
        z = np.add.reduceat(att[:, None] * h, bag[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "att": att, "z": z, "row": row, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))}

    def gradients(self, f: dict, y: np.ndarray, bag: np.ndarray) -> dict:
        p, row = self.p, f["row"]
        dl = (f["score"] - y) / len(y)
        dz = dl[:, None] * p["c"]
        da = (dz[row] * f["h"]).sum(axis=1)
        dh = f["att"][:, None] * dz[row]
        ds = f["att"] * (da - np.add.reduceat(f["att"] * da, bag[:-1])[row])
        dt = ds[:, None] * f["g"] * p["a"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * f["t"] * p["a"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds,
                "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = 800, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4):
        if not len(bags):
            return self
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(axis=0), flat.std(axis=0) + 1e-2
        rng = np.random.default_rng(5)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(bags), min(batch, len(bags)))
            bag = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            f = self.forward(np.concatenate([bags[i] for i in pick]), bag)
            for k, grad in self.gradients(f, y[pick], bag).items():
                grad = grad + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.blocks(batches, "text"):
        bag, x = passages(part.column("text"))
        rows = [x[a:b].ravel() for a, b in zip(bag[:-1], bag[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label"), pa.array(rows, pa.list_(pa.float32()))],
                                         names=["id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          per_class: int = PER_CLASS) -> AttentionModel:
    rows = sample(docs, labels, label, per_class, id_col, text_col).mapInArrow(_bags, "id string, label int, x array<float>").toArrow()
    order = pc.sort_indices(rows, [("id", "ascending"), ("label", "ascending")])
    rows = rows.take(order)
    y = rows.column("label").to_numpy().astype(float)
    bags = [np.asarray(x.values, dtype=np.float64).reshape(-1, WIDTH) for x in rows.column("x")]
    return AttentionModel(WIDTH).fit(bags, y)


def _scores(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text"):
            bag, x = passages(part.column("text"))
            f = model.forward(x.astype(np.float64), bag)
            top = np.maximum.reduceat(f["att"], bag[:-1])
            first = np.flatnonzero(f["att"] == top[f["row"]])
            best = first[np.searchsorted(f["row"][first], np.arange(len(bag) - 1))] - bag[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(f["score"]), pa.array(best.astype(np.int64) * PASSAGE), pa.array(top)],
                names=["id", "held_out", "score", "passage_word", "attention"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, passage_word, attention of every row.

    score: 0 to 1, higher for label 1; passage_word and attention: first word
    and weight of the passage that counts most. A null or empty text is one
    passage of zeros. Rows of null id are scored and are not held out; repeated
    rows are scored each; labels that are null count as missing. Without any
    label every score is that of the unfitted model. Other columns are ignored.
    """
    model = train(docs, labels, "quality", id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = src.mapInArrow(_scores(model), f"id {kind}, held_out boolean, score double, passage_word long, attention double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                      "passage_word", "attention")
