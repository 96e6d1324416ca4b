"""Tables as text, note files, versioned state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import ordered_text
from ..plans.ranking import group_rank
from ..session import scratch_path

C = F.lit


def row_text(df: DataFrame, columns: list[str], sep: str = " | ") -> DataFrame:
    """Adds ``line``: the row's cells joined, NULL cells empty; NULL when all
    cells are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), C("")) for c in columns]
    some = F.exists(F.array(*cells), lambda x: x != "")
    return df.withColumn("line", F.when(some, F.concat_ws(sep, *cells)))


def sheet_text(lines: DataFrame, sheet: list[str], order: str) -> DataFrame:
    """sheet, text, n: the lines of a sheet under a ``## name`` header.

    ``sheet`` is a name column, and for tables that do not fit one text a part
    column that keeps the rows per text small.
    """
    name = F.col(sheet[0]).cast("string")
    return lines.groupBy(*sheet).agg(ordered_text(order, F.col("line"), "\n").alias("text"), F.count("*").alias("n")).withColumn(
        "text", F.concat(C("## "), name, C("\n"), "text"))


def number_clashes(rows: DataFrame, folder: str, base: str, order: list[str], ext: str = ".md") -> DataFrame:
    """Adds ``file``: dir/base.md, and _1, _2, … for later rows of one name.

    ``order`` is unique per row; a name shared by very many rows is numbered
    over many tasks.
    """
    ranked = group_rank(rows, [folder, base], order, "_rn")
    n = F.col("_rn") - 1
    name = F.concat(F.col(base), F.when(n > 0, F.concat(C("_"), n.cast("string"))).otherwise(""), C(ext))
    return ranked.withColumn("file", F.concat_ws("/", F.when(F.col(folder) != "", F.col(folder)), name)).drop("_rn")


def write_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages below one folder per category and return them as read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "pages")
    pages.write.partitionBy("category").parquet(path)
    return spark.read.option("basePath", path).parquet(path)


def write_note_files(pages: DataFrame, path: str) -> None:
    """One text file row per page, by category (columns category, content)."""
    pages.select("category", F.col("content").alias("value")).write.partitionBy("category").mode("append").text(path)


def write_report(counters: DataFrame, path: str) -> None:
    """Counters of a run as JSON lines."""
    counters.write.mode("overwrite").json(path)


class StateTable:
    """A keyed table kept as numbered Parquet versions below one folder.

    A new version is written in full beside the one being read; the highest
    version that was committed is current, so a failed write changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        jvm, p, fs = self._fs()
        if not fs.exists(p):
            return 0
        names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v")]
        done = [int(n.getName()[1:]) for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        v = self.version()
        if v == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame) -> DataFrame:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        return self.read()
