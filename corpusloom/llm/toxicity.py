"""Toxicity by multiple-instance learning over sentences.

A document is toxic if any sentence is: its score is the noisy-or of sentence
scores, and sentence weights are learned from document labels alone. A sentence
scores by the marked features (words and word beginnings) it holds. The scores
then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle_table
from . import words as W
from .fit import class_sizes, held_out, sample

#: A sentence ends at its mark or after this many words.
SENTENCE = 64
#: Labelled documents of a class that are fitted; every feature that tells the classes apart is kept.
PER_CLASS = 12_000
BEGINNINGS = (4, 5, 6)
#: Steps of the fit, each one a pass of the tasks over the sample, and the rate of the first.
STEPS, RATE = 40, 0.3
#: Share of a feature's log odds among documents that its weight starts from and is drawn to.
PRIOR = 0.5


def word_features(vocabulary: pa.Array) -> list[pa.Array]:
    """The features of each word: itself, lower-cased without marks, and its beginnings."""
    word = pc.replace_substring_regex(pc.utf8_lower(vocabulary.cast(pa.large_string())), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    out = [word]
    for n in BEGINNINGS:
        start = pc.utf8_slice_codeunits(word, 0, n)
        marked = pc.replace_substring_regex(start, "$", "*")
        out.append(pc.if_else(pc.equal(pc.utf8_length(start), n), marked, pa.scalar("", pa.large_string())))
    return out


def sentences(text: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """(words, sentence of each word, first sentence of each text)."""
    w = W.split(text)
    row = W.row_of(w.offsets)
    if not len(w.codes):
        return w, np.zeros(0, np.int64), np.zeros(len(w.offsets), np.int64)
    closes = pc.match_substring_regex(w.vocabulary.cast(pa.large_string()), r"[.!?…][\"')»”]*$").to_numpy(zero_copy_only=False)[w.codes]
    first = np.concatenate(([True], row[1:] != row[:-1]))
    begins = first | np.concatenate(([False], closes[:-1]))
    run = np.flatnonzero(begins)
    inside = np.arange(len(begins)) - np.repeat(run, np.diff(np.append(run, len(begins))))
    begins |= inside % SENTENCE == 0
    number = np.cumsum(begins) - 1
    before = np.concatenate((number, [number[-1] + 1]))
    return w, number, before[w.offsets]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents of label 1, of label 0) of each block."""
    for part in W.blocks(batches, "text"):
        w = W.split(part.column("text"))
        if not len(w.codes):
            continue
        row, toxic = W.row_of(w.offsets), part.column("label").to_numpy() == 1
        for feature in word_features(w.vocabulary):
            coded = feature.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
            pair = np.unique(ids * part.num_rows + row)
            held, at = np.divmod(pair, part.num_rows)
            n = len(coded.dictionary)
            ones, all_ = np.bincount(held[toxic[at]], minlength=n), np.bincount(held, minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(ones), pa.array(all_ - ones)], names=["feature", "ones", "zeros"])


def _weights_of(vocabulary: pa.Array, names: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Summed weight of each word's features."""
    total = np.zeros(len(vocabulary))
    padded = np.append(weights, 0.0)
    for feature in word_features(vocabulary):
        at = pc.fill_null(pc.index_in(feature, value_set=names), len(weights)).to_numpy(zero_copy_only=False)
        total += padded[at]
    return total


#: Arrays of a block of sample documents: label and blank sentences of each; document, copies
#: and end in ``feature`` of each sentence that holds features.
BLOCK = "label array<int>, blank array<int>, own array<int>, copies array<int>, stop array<int>, feature array<int>"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def fold(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, copies, stop, feature): the sentences' features, equal sentences of a document once.

    Sentences are numbered through; each (sentence, feature) hit may repeat and counts as often.
    """
    order = np.lexsort((feature, sentence))
    doc, sentence, feature = doc[order], sentence[order], feature[order]
    start = np.flatnonzero(np.diff(sentence, prepend=-1))
    size = np.diff(np.append(start, len(sentence)))
    text, at = {}, np.zeros(len(start), np.int64)
    feature = np.ascontiguousarray(feature, np.int32)
    for i, (d, a, n) in enumerate(zip(doc[start].tolist(), start.tolist(), size.tolist(), strict=True)):
        at[i] = text.setdefault((d, feature[a:a + n].tobytes()), len(text))
    first = np.unique(at, return_index=True)[1]
    copies = np.bincount(at, minlength=len(first))
    return doc[start][first], copies, np.cumsum(size[first]), feature[W.take_ranges(start[first], size[first])]


def _blocks(names: list[str]):
    """One row per block of sample documents."""
    known = pa.array(names, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text"):
            w, number, first = sentences(part.column("text"))
            row, sent, feat = [], [], []
            for feature in word_features(w.vocabulary):
                at = pc.fill_null(pc.index_in(feature, value_set=known), -1).to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, int)
                hit = np.flatnonzero(at >= 0)
                row.append(W.row_of(w.offsets)[hit])
                sent.append(number[hit])
                feat.append(at[hit])
            row, sent, feat = map(np.concatenate, (row, sent, feat))
            blank = np.diff(first) - np.bincount(row[np.unique(sent, return_index=True)[1]], minlength=part.num_rows)
            own, copies, stop, feat = fold(row, sent, feat)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32()))
                 for x in (part.column("label").to_numpy(), blank, own, copies, stop, feat)], names=BLOCK_COLUMNS)

    return run


def gradient(block: dict[str, np.ndarray], class_weight: tuple[float, float], w: np.ndarray, bias: float) -> np.ndarray:
    """Gradient of the weighted log loss of a block's documents, the bias last."""
    label, blank, own, copies, stop, feature = (block[c] for c in BLOCK_COLUMNS)
    docs, size = len(label), np.diff(stop, prepend=0)
    sent = np.repeat(np.arange(len(own)), size)
    z = bias + np.bincount(sent, w[feature], len(own))
    p, base = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-bias))
    miss = np.bincount(own, copies * np.log1p(-np.minimum(p, 1 - 1e-12)), docs) + blank * np.log1p(-base)
    score = np.maximum(-np.expm1(miss), 1e-12)
    pull = np.where(label == 1, class_weight[1], class_weight[0]) * (score - label) / score
    dz = pull[own] * p * copies
    return np.append(np.bincount(feature, dz[sent], len(w)), dz.sum() + (pull * blank).sum() * base)


def _gradients(class_weight: tuple[float, float], w: np.ndarray, bias: float):
    """One summed gradient per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                total += gradient({c: batch.column(c)[i].values.to_numpy() for c in BLOCK_COLUMNS}, class_weight, w, bias)
        yield pa.RecordBatch.from_arrays([W.list_array(np.array([0, len(total)]), total)], names=["g"])

    return run


class NoisyOr:
    """Sentence weights; a document's score is one minus the product of misses."""

    def __init__(self, names: list[str], prior: np.ndarray | None = None):
        self.names, self.prior = names, np.zeros(len(names)) if prior is None else np.maximum(0, prior)
        self.w, self.bias = self.prior.copy(), -6.0

    def descend(self, slope, steps: int = STEPS, rate: float = RATE, decay: float = 3e-5):
        """Adam on ``slope(w, bias)``, the gradient over all documents, with a rate that falls to a tenth."""
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for step in range(1, steps + 1):
            grad = slope(self.w, self.bias) + np.append(decay * (self.w - self.prior), 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = rate * 0.1 ** (step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.w = np.maximum(0, self.w - move[:-1])  # a feature never speaks for a sentence
            self.bias = float(np.clip(self.bias - move[-1], -8, 0))
        return self

    def fit(self, label, sentences_of, at, feature):
        """The same on documents at hand: ``at`` and ``feature`` list each one's (sentence, feature) hits."""
        if not len(label):
            return self
        doc = np.repeat(np.arange(len(label)), [len(x) for x in at])
        number = doc * (int(max(sentences_of)) + 1) + np.concatenate([*at, np.zeros(0, np.int64)])
        feature = np.concatenate([*feature, np.zeros(0, np.int64)])
        blank = sentences_of - np.bincount(doc[np.unique(number, return_index=True)[1]], minlength=len(label))
        block = dict(zip(BLOCK_COLUMNS, (np.asarray(label), blank, *fold(doc, number, feature)), strict=True))
        return self.descend(lambda w, bias: gradient(block, (1 / len(label),) * 2, w, bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          per_class: int = PER_CLASS) -> NoisyOr:
    rows = settle_table(sample(docs, labels, label, per_class, id_col, text_col))
    share = class_sizes(labels, label, id_col)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    counted = (
        rows.mapInArrow(_document_counts, "feature string, ones long, zeros long").filter("feature <> ''")
        .groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    )
    # how far the rate of label 1 is above that of label 0, in standard errors
    a, b = F.col("ones") / ones, F.col("zeros") / zeros
    far = (a - b) / F.sqrt((F.col("ones") + 0.5) / ones**2 + (F.col("zeros") + 0.5) / zeros**2)
    chosen = counted.filter("ones > 2").withColumn("far", far).filter("far > 2")
    told = {r["feature"]: PRIOR * r["odds"] for r in chosen.select("feature", F.log(
        ((F.col("ones") + 0.5) / ones) / ((F.col("zeros") + 0.5) / zeros)).alias("odds")).collect()}
    names = sorted(told)
    model = NoisyOr(names, np.array([told[n] for n in names]))
    # classes weigh by their true share; all weights together are 1
    weight = share[0] / zeros, share[1] / ones
    whole = weight[0] * totals.get(0, 0) + weight[1] * totals.get(1, 0)
    if not whole or not names:
        return model
    weight = weight[0] / whole, weight[1] / whole
    blocks = settle_table(rows.select("label", "text").mapInArrow(_blocks(names), BLOCK))

    def slope(w, bias):
        got = blocks.mapInArrow(_gradients(weight, w, bias), "g array<double>").toArrow().column("g")
        return np.sum([np.asarray(x.values) for x in got], axis=0)

    return model.descend(slope)


def _judge(model: NoisyOr, text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Score of each text, and the first words of its offending sentences."""
    w, number, first = sentences(text)
    total, rows = int(first[-1]), len(text)
    weight = _weights_of(w.vocabulary, pa.array(model.names, pa.large_string()), model.w)[w.codes]
    p = 1 / (1 + np.exp(-np.clip(model.bias + np.bincount(number, weight, total), -30, 30)))
    doc = np.repeat(np.arange(rows), np.diff(first))
    score = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))
    bad = np.flatnonzero(p >= 0.5)
    word = np.searchsorted(number, bad) - w.offsets[:-1][doc[bad]]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[bad], minlength=rows))))
    return np.clip(score, 0, 1), W.list_array(cuts, word.astype(np.int64))


def _scores(model: NoisyOr):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, "text", 1 << 20):
            score, word = _judge(model, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score), word],
                                             names=["id", "held_out", "score", "sentence_words"])

    return run


def _clean(model: NoisyOr, threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.blocks(batches, text_col, 1 << 20):
            yield part.filter(pa.array(_judge(model, part.column(text_col))[0] < threshold))

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, sentence_words of every row.

    score: 0 to 1, higher for label 1; sentence_words: number of the first word
    of each sentence that scores 0.5 or more. A null or empty text has no
    sentence and scores 0. Rows of null id are scored and are not held out;
    repeated rows are scored each; null labels count as missing. Without any
    label 1 every score is close to 0. Other columns are ignored.
    """
    model = train(docs, labels, "toxic", id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = src.mapInArrow(_scores(model), f"id {kind}, held_out boolean, score double, sentence_words array<long>")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentence_words")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = train(docs, labels, "toxic", id_col, text_col)
    return docs.mapInArrow(_clean(model, threshold, text_col), docs.schema)
