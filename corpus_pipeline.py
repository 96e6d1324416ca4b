"""The corpus pipeline: five stages from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, mixing, packing, pii, toxicity
from corpusloom.llm.queries import SURROGATE_KEY, table, tokenizer
from corpusloom.session import settle_table

#: Rows of a batch between Spark and Python. Whole texts are wide, so fewer than Spark's 10,000.
BATCH_ROWS = "2000"


def narrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scores reject go."""
    narrow_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    narrow_batches(spark)
    return jaccard.one_per_group(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private entities are replaced by surrogates; n_chars follows the text."""
    narrow_batches(spark)
    return pii.surrogates(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    narrow_batches(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their place in the sequences."""
    narrow_batches(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii_surrogates", replace_private),
    ("source_mix", mix_sources),
    ("packing", pack_windows),
]

#: The toxicity scores come from a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table that the next reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle_table(docs)
    return docs
