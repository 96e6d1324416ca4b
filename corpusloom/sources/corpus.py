"""Notes, links and pages built from the raw tables by fixed rules.

Each rule is a plain projection, so the same rule can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LATIN_KEYWORD = r"\p{L}{2,4}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for text work on an input of few splits.

    Only an input with fewer splits than task slots (at most slots x one split
    of data) is shuffled; larger ones are read as they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_name, category, tags, summary (the whole text), rel_path."""
    d = spread(table(spark, sf_dir, "documents"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    category = F.concat_ws("/", "lang", "source")
    return d.select(
        "doc_id",
        name.alias("note_name"),
        category.alias("category"),
        T.longest_tokens("text").alias("tags"),
        F.col("text").alias("summary"),
        F.concat(category, F.lit("/"), name, F.lit(".md")).alias("rel_path"),
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two links each (texts under 300 characters have none)."""
    d = spread(table(spark, sf_dir, "documents"))
    n = d.agg(F.count("*").alias("n")).scalar()
    ident = F.col("doc_id")
    one = F.concat(F.lit("[[d"), ((ident * 7 + 1) % F.floor(n * 6 / 5)).cast("string"), F.lit("]]"))
    two = F.concat(F.lit("[[d"), ((ident * 13 + 5) % n).cast("string"), F.lit("|see]]"))
    body = F.when(F.col("n_chars") >= 300, F.concat_ws(" ", F.concat(F.col("text"), F.lit("\n\n\n")), one, two))
    name = F.concat(F.lit("d"), ident.cast("string"))
    return d.select(
        "doc_id",
        name.alias("note_name"),
        F.concat_ws("/", "lang", "source", name).alias("path"),
        F.coalesce(body, "text").alias("content"),
        F.concat_ws("/", "lang", "source").alias("category"),
    )


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: front matter, title, each third line a heading."""
    nt = notes(spark, sf_dir)
    lines = F.transform(
        F.split("summary", "\n"),
        lambda s, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("## "), s)).otherwise(s),
    )
    front = F.concat(
        F.lit("---\nsource: "), "note_name", F.lit(".md\ncategory: "), "category",
        F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"),
    )
    return nt.select(
        "doc_id", "note_name", "category", "tags", "rel_path",
        F.concat(front, F.lit("# "), "note_name", F.lit("\n"), F.array_join(lines, "\n")).alias("content"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path (site + URL path without query and fragment), title, ext."""
    p = spread(table(spark, sf_dir, "pages"))
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    path = F.regexp_replace(bare, "/$", "")
    return p.select(
        "page_id", "url",
        path.alias("path"),
        F.concat(path, F.lit("/"), F.col("page_id").cast("string")).alias("page_path"),
        F.lower(F.regexp_replace(path, r"^[^/]*", "")).alias("page_key"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a call log: provider, order, outcome, latency, tokens."""
    return as_calls(table(spark, sf_dir, "events"))


def as_calls(e: DataFrame) -> DataFrame:
    outcome = (
        F.when(F.col("event_type") == "error", "rate_limit")
        .when(F.col("event_type") == "signup", "server_error")
        .when(F.col("event_type") == "purchase", "other_error")
        .otherwise("ok")
    )
    return e.select(
        F.col("user_id").alias("provider"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        outcome.alias("outcome"),
        F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
