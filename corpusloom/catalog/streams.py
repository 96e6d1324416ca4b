"""Queries that run streams over the tables and read the result."""

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import corpus as S
from ..streaming import streams
from .operations import COUNTS, QUEUE, RUNS, STREAKS, tasks
from .registry import query

#: Micro-batches of each stream and rows of a file.
BATCHES, PER_FILE = 4, 1_000_000


def done(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def arrivals(rows, by):
    """The rows as a stream of BATCHES micro-batches, ascending in the integer ``by``.

    Each batch is written by a job of its own, as the same number of files, so
    that files arrive in batch order whatever their number. Equal values of
    ``by`` are in one batch, null ones in the first.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "arrivals")
    rows = rows.withColumn("_by", F.coalesce(by, F.lit(-(1 << 63))))
    shares = [i / BATCHES for i in range(1, BATCHES)]
    cuts, n = rows.agg(F.percentile_approx("_by", shares), F.count("*")).first()
    per_batch = max(1, -(-n // (BATCHES * PER_FILE)))
    cuts = cuts or [0] * len(shares)
    batch = sum((F.col("_by") > c).cast("int") for c in cuts)
    for b in range(BATCHES):
        rows.filter(batch == b).drop("_by").repartition(per_batch).write.mode("append").parquet(path)
    return streams.table_stream(spark, path, per_batch)


def in_order(text):
    """An integer that ascends with the text: its first seven bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(text).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def files(spark, sf):
    """One row per document: path, md5, category and a time; all within a day."""
    d = S.table(spark, sf, "documents")
    last = d.agg(F.max("doc_id")).scalar()
    ms = F.floor(F.col("doc_id") * 80_000_000 / (last + 1)) + 1_700_000_000_000
    return d.select(
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.timestamp_millis(ms).alias("ts"), F.concat_ws("/", "lang", "source").alias("category"))


def events(spark, sf):
    return S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest", """SELECT md5(text) AS md5, min(lang || '/' || source || '/' || doc_id) AS path, 'success' AS status FROM documents GROUP BY 1""")
def stream_ingest(spark, sf):
    work = scratch_path(spark, "ingest")
    done(streams.ingest(arrivals(files(spark, sf).select("path", "md5"), in_order("path")), work, within_batch=True))
    return streams.results(spark, work, streams.INDEX)


@query("stream_unique", "SELECT DISTINCT md5(text) AS md5 FROM documents")
def stream_unique(spark, sf):
    work = scratch_path(spark, "unique")
    done(streams.unique_content(arrivals(files(spark, sf).select("md5", "ts"), F.unix_micros("ts")), work, "1 day"))
    return streams.results(spark, work, "md5 string, ts timestamp").select("md5")


@query("stream_tree_counts", """SELECT prefix, count(*) AS n FROM (SELECT lang AS prefix FROM documents
  UNION ALL SELECT lang || '/' || source FROM documents) GROUP BY 1""")
def stream_tree_counts(spark, sf):
    work = scratch_path(spark, "tree")
    done(streams.tree_counts(arrivals(files(spark, sf).select("category"), in_order("category")), work))
    return streams.newest(spark, work, "prefix string, n bigint, batch bigint", ["prefix"], "batch")


@query("stream_health", f"""WITH {RUNS}, w AS (SELECT date_trunc('day', ts) AS start, {COUNTS} FROM f GROUP BY 1)
SELECT epoch_us(start) AS start, processed, succeeded, failed, skipped, elapsed, fail_rate, healthy FROM w
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_health(spark, sf):
    work = scratch_path(spark, "health")
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("ok")
    rows = events(spark, sf).select("ts", status.alias("status"), F.col("value").alias("elapsed"))
    done(streams.health(arrivals(rows, F.unix_micros("ts")), work))
    out = spark.read.parquet(f"{work}/out")
    return out.withColumn("start", F.unix_micros("start")).withColumn("elapsed", F.round("elapsed", 4)).withColumn(
        "fail_rate", F.round("fail_rate", 6))


def calls(spark, sf):
    rows = S.as_calls(events(spark, sf)).select("provider", "ts", "seq", "outcome")
    return arrivals(rows, F.unix_micros("ts"))


@query("stream_cooldown", f"WITH {STREAKS} SELECT provider, seq, outcome, rate_limit, server_error, CAST(cooldown AS INTEGER) AS cooldown FROM cd")
def stream_cooldown(spark, sf):
    work = scratch_path(spark, "cooldown")
    done(streams.cooldown(calls(spark, sf), work))
    out = streams.results(spark, work, streams.CALLS)
    return out.select("provider", "seq", "outcome", "rate_limit", "server_error", "cooldown")


@query("stream_rests", f"""WITH {STREAKS}, a AS (SELECT provider, ts, seq, outcome = 'ok' AS ok,
  date_trunc('second', ts) + to_seconds(CAST(cooldown AS INTEGER)) AS until FROM cd WHERE outcome <> 'other_error'),
b AS (SELECT *, lag(ok) OVER w AS was_ok, lag(until) OVER w AS was_until FROM a WINDOW w AS (PARTITION BY provider ORDER BY ts, seq)),
c AS (SELECT *, sum(CASE WHEN NOT ok AND (was_ok IS NULL OR was_ok OR was_until <= ts) THEN 1 ELSE 0 END) OVER w AS g,
  lead(ts) OVER w AS next_ts FROM b WINDOW w AS (PARTITION BY provider ORDER BY ts, seq)),
d AS (SELECT provider, min(ts) AS start, count(*) AS failures, max_by(until, seq) AS until, max_by(next_ts, seq) AS next_ts
  FROM c WHERE NOT ok GROUP BY provider, g)
SELECT provider, epoch_us(start) AS start, epoch_us(CASE WHEN next_ts < until THEN next_ts ELSE until END) AS finish, failures,
  CASE WHEN next_ts < until THEN 'success' ELSE 'timer' END AS ended_by
FROM d WHERE next_ts IS NOT NULL OR until <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_rests(spark, sf):
    work = scratch_path(spark, "rests")
    done(streams.rests(calls(spark, sf), work))
    out = streams.results(spark, work, streams.RESTS)
    return out.withColumn("start", F.unix_micros("start")).withColumn("finish", F.unix_micros("finish"))


@query("stream_queue", f"WITH {QUEUE} SELECT task_id, path, status, retry_count, seq FROM q")
def stream_queue(spark, sf):
    work = scratch_path(spark, "queue")
    o = (F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "cancel")
         .when(F.col("event_type") == "click", "processing").otherwise("done"))
    rows = events(spark, sf).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ord"), o.alias("outcome"))
    done(streams.queue(arrivals(rows, F.col("ord")), tasks(spark, sf), work))
    return streams.newest(spark, work, streams.CHANGES, ["path"], "version")
