"""Model enrichment: any function over batches of requests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Answer = Callable[[pd.Series], pd.Series]


def longest_sentences(bodies: pd.Series, n: int = 3) -> pd.Series:
    """Offline stand-in for a summary model: the n longest sentences of the
    whole text in their order."""

    def one(body: str) -> str:
        parts = body.split(". ")
        best = sorted(range(len(parts)), key=lambda i: (-len(parts[i]), i))[:n]
        return ". ".join(parts[i] for i in sorted(best))

    return bodies.map(one)


def longest_words(bodies: pd.Series, n: int = 8) -> pd.Series:
    """Offline stand-in for a tag model: the n longest words, comma-separated."""

    def one(body: str) -> str:
        words = set(re.findall(r"[^\W\d_]{4,20}", body.lower()))
        return ",".join(sorted(words, key=lambda w: (-len(w), w))[:n])

    return bodies.map(one)


def enrich(requests: DataFrame, fn: Answer, keys: list[str]) -> DataFrame:
    """keys, answer, error for each request (column ``body``).

    Rows with ``send`` false answer with their body and never reach ``fn``.
    A batch that fails is retried row by row, so an error stays with its row.
    Put ``repartition(n)`` before this to bound how many calls run at once.
    """

    def answer(bodies: pd.Series) -> tuple[pd.Series, pd.Series]:
        try:
            return fn(bodies), pd.Series([None] * len(bodies), index=bodies.index, dtype=object)
        except Exception:
            got, err = [], []
            for i in bodies.index:
                try:
                    got.append(fn(bodies.loc[[i]]).iloc[0])
                    err.append(None)
                except Exception as e:
                    got.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            return pd.Series(got, index=bodies.index, dtype=object), pd.Series(err, index=bodies.index, dtype=object)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, err = answer(pdf["body"])
            yield pdf[keys].assign(answer=got, error=err)

    fields = [f for f in requests.schema.fields if f.name in keys]
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: keys.index(f.name)))
    schema = f"{cols}, answer string, error string"
    asked = requests.filter("send").select(*keys, "body").mapInPandas(step, schema)
    plain = requests.filter("NOT send").selectExpr(*keys, "body AS answer", "CAST(NULL AS STRING) AS error")
    return asked.unionByName(plain)


def split_errors(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)."""
    return answers.filter("error IS NULL").drop("error"), answers.filter("error IS NOT NULL")
