"""Structured Streaming jobs.

Each function starts a query that works off what is there (``availableNow``)
or keeps running with another trigger, and returns the query; results land in
Parquet below the given folder and are read with ``results`` or ``newest``.
State per key lies in the engine's state store (``state``), so a lost executor
or a restart goes on from the last finished micro-batch.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import moc, observe
from ..plans.ranking import latest
from . import state

INDEX = "md5 string, path string, status string"
TASKS = "task_id string, path string, status string, retry_count bigint, seq bigint"
CHANGES = f"{TASKS}, version bigint"
CALLS = "provider bigint, ts timestamp, seq bigint, outcome string, rate_limit bigint, server_error bigint, cooldown int"
RESTS = "provider bigint, start timestamp, finish timestamp, failures bigint, ended_by string"


def _start(df: DataFrame, work: str, trigger: dict | None):
    return df.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(**(trigger or {"availableNow": True}))


#: Keyed processors need this store; it uploads only what a micro-batch changed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _store(spark: SparkSession):
    """STORE for a query that starts inside; the session keeps its own settings."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _append(df: DataFrame, work: str, trigger: dict | None) -> StreamingQuery:
    with _store(df.sparkSession):
        return _start(df, work, trigger).format("parquet").option("path", f"{work}/out").outputMode("append").start()


def results(spark: SparkSession, work: str, schema: str) -> DataFrame:
    """What a stream has written so far; no rows before its first micro-batch."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/out")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{work}/out")


def newest(spark: SparkSession, work: str, schema: str, keys: list[str], version: str) -> DataFrame:
    """The last written row of each key."""
    return latest(results(spark, work, schema), keys, [F.col(version).desc()]).drop(version)


def table_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Stream of a Parquet file or folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def ingest(files: DataFrame, work: str, within_batch: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Record content seen for the first time (INDEX rows). files: path, md5.

    Copies inside one micro-batch all pass unless ``within_batch``, which
    keeps the smallest path. Rows without md5 are left out.
    """
    rows = files.select("md5", "path").filter("md5 IS NOT NULL")
    fresh = rows.groupBy("md5").transformWithState(state.FirstSeen(within_batch), INDEX, "Append", "None")
    return _append(fresh, work, trigger)


def unique_content(files: DataFrame, work: str, keep: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """First arrival of each content within the watermark. files: md5, ts, …"""
    once = files.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["md5"])
    return _append(once, work, trigger)


def tree_counts(pages: DataFrame, work: str, trigger: dict | None = None) -> StreamingQuery:
    """Subtree counts after each micro-batch. pages: category."""
    counts = pages.select(F.explode(moc.prefixes("category")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    return _start(counts, work, trigger).outputMode("complete").foreachBatch(step).start()


def health(file_events: DataFrame, work: str, window: str = "1 day", late: str = "1 hour",
           trigger: dict | None = None) -> StreamingQuery:
    """Counters and health per time window; late rows are dropped, the open
    window is not written. file_events: ts, status, elapsed."""
    win = file_events.withWatermark("ts", late).groupBy(F.window("ts", window))
    out = observe.with_health(win.agg(*observe.run_counters())).withColumn("start", F.col("window.start")).drop("window")
    return _append(out, work, trigger)


def _by_provider(calls: DataFrame):
    """Calls with their time in microseconds, without rows that cannot be placed."""
    return calls.filter("provider IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL").withColumn("at", F.unix_micros("ts"))


def cooldown(calls: DataFrame, work: str, trigger: dict | None = None) -> StreamingQuery:
    """Each call with running failure streaks (CALLS rows). calls: provider, ts, seq, outcome.

    Per provider the state is its streaks after the last call. Calls of one
    micro-batch are taken in time order, later arrivals after them. A task
    holds 17 bytes per call of one provider in a micro-batch.
    """
    rows = _by_provider(calls).select("provider", "at", "seq", "outcome")
    raw = "provider bigint, at bigint, seq bigint, kind int, rate_limit bigint, server_error bigint, cooldown int"
    out = rows.groupBy("provider").transformWithStateInPandas(state.Streaks(), raw, "Append", "None")
    names = F.array(*[F.lit(k) for k in [*state.KINDS, "other_error", "ok"]])
    return _append(out.select(
        "provider", F.timestamp_micros("at").alias("ts"), "seq", F.get(names, F.col("kind")).alias("outcome"),
        *state.KINDS, "cooldown"), work, trigger)


def rests(calls: DataFrame, work: str, late: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Finished rests of each provider (RESTS rows). calls: provider, ts, seq, outcome.

    A rest ends with a success or by an event-time timer at its end; calls
    older than the watermark are dropped. Open rests are not written.
    """
    rows = _by_provider(calls.withWatermark("ts", late)).select("provider", "ts", "at", "seq", "outcome")
    raw = "provider bigint, start bigint, finish bigint, failures bigint, ended_by string"
    out = rows.groupBy("provider").transformWithStateInPandas(state.Rests(), raw, "Append", "EventTime")
    when = lambda c: F.timestamp_micros(c).alias(c)
    return _append(out.select("provider", when("start"), when("finish"), "failures", "ended_by"), work, trigger)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` as the first start of a stream wrote them."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def queue(outcomes: DataFrame, tasks: DataFrame, work: str, max_retries: int = K.MAX_RETRIES,
          trigger: dict | None = None) -> StreamingQuery:
    """Tasks that changed, per micro-batch (CHANGES rows). outcomes: path, ord, outcome.

    ``tasks`` is the initial state, one row per path, kept below ``work`` at the
    first start; paths without a task give nothing. What a task's end state
    needs can be merged in any order of arrival: the number of fails, the newest
    outcome that is not a cancel and the newest cancel. The engine keeps these
    per task and merges them in the input tasks first, so a path with a third
    of all rows sends one row per input task. ``newest`` by ``version``, the
    number of the micro-batch, gives the table.
    """
    first = _kept(tasks.select("path", "task_id", "status", "retry_count", "seq").filter("path IS NOT NULL"), f"{work}/tasks")
    rows = outcomes.select("path", F.col("ord").cast("bigint").alias("ord"), "outcome").filter("outcome IS NOT NULL")
    act = (F.col("outcome") != "cancel") & F.col("ord").isNotNull()
    merged = rows.join(first, "path").groupBy("path", "task_id", "status", "retry_count", "seq").agg(
        F.count_if(F.col("outcome") == "fail").alias("fails"), F.max(F.when(act, F.struct("ord", "outcome"))).alias("last"),
        F.max(F.when(F.col("outcome") == "cancel", F.col("ord"))).alias("cancel_ord"))
    tries, act = F.col("retry_count") + F.col("fails"), F.col("last.outcome")
    status = (F.when(act.isin("done", "processing"), act)
              .when(act == "fail", F.when(tries < max_retries, "pending").otherwise("failed")).otherwise(F.col("status")))
    late = F.col("cancel_ord").isNotNull() & (F.col("last").isNull() | (F.col("cancel_ord") > F.col("last.ord")))
    out = merged.withColumn("state", status).select(
        "task_id", "path", F.when(late & F.col("state").isin("pending", "processing"), "cancelled").otherwise(F.col("state")).alias("status"),
        tries.alias("retry_count"), "seq")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/version={batch_id}")

    with _store(outcomes.sparkSession):
        return _start(out, work, trigger).outputMode("update").foreachBatch(step).start()
