"""Queries on runs, providers, queues, repair plans and streams."""

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import incremental, moc, observe, repair, work_queue
from ..sources import corpus as S
from .registry import CALLS, WEB, query

C = F.lit


# ---- run and provider health ------------------------------------------------------------

def file_events(spark, sf):
    e = S.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("ok")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("file"), status.alias("status"),
                    F.col("value").alias("elapsed"), F.col("props").alias("detail"), F.col("ts").cast("timestamp").alias("ts"))


RUNS = """f AS (SELECT user_id AS run, event_id AS file, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'ok' END AS status,
  value AS elapsed, props AS detail, ts FROM events)"""
COUNTS = """count(*) AS processed, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'fail') AS failed,
  count(*) FILTER (status = 'skip') AS skipped, round(sum(elapsed), 4) AS elapsed,
  round(count(*) FILTER (status = 'fail') / count(*)::DOUBLE, 6) AS fail_rate, count(*) FILTER (status = 'fail') / count(*)::DOUBLE <= 0.5 AS healthy"""


@query("run_health", f"WITH {RUNS} SELECT run, {COUNTS} FROM f GROUP BY run")
def run_health(spark, sf):
    h = observe.run_health(file_events(spark, sf), ["run"])
    return h.withColumn("elapsed", F.round("elapsed", 4)).withColumn("fail_rate", F.round("fail_rate", 6))


@query("run_totals", f"WITH {RUNS} SELECT {COUNTS} FROM f")
def run_totals(spark, sf):
    h = observe.run_health(file_events(spark, sf))
    return h.withColumn("elapsed", F.round("elapsed", 4)).withColumn("fail_rate", F.round("fail_rate", 6))


@query("run_errors", f"WITH {RUNS} SELECT file, detail AS error, round(elapsed, 2) AS elapsed FROM f WHERE status = 'fail'")
def run_errors(spark, sf):
    return observe.run_errors(file_events(spark, sf))


@query("usage_totals", f"""WITH {CALLS} SELECT count(*) FILTER (outcome = 'ok') AS api_calls, CAST(sum(tokens) FILTER (outcome = 'ok') AS BIGINT) AS tokens,
  round(sum(latency) FILTER (outcome = 'ok'), 4) AS total_latency, round(avg(latency) FILTER (outcome = 'ok'), 6) AS avg_latency,
  count(*) FILTER (outcome <> 'ok') AS errors FROM calls""")
def usage_totals(spark, sf):
    u = observe.usage_totals(S.calls(spark, sf))
    return u.withColumn("total_latency", F.round("total_latency", 4)).withColumn("avg_latency", F.round("avg_latency", 6))


@query("provider_health", f"""WITH {CALLS}, g AS (SELECT provider, count(*) FILTER (outcome = 'ok') AS success,
  count(*) FILTER (outcome <> 'ok') AS failure, count(*) FILTER (outcome = 'rate_limit') AS rate_limits FROM calls GROUP BY 1),
s AS (SELECT *, greatest(0.0, success / (success + failure)::DOUBLE - least(0.5, 2 * rate_limits / (success + failure)::DOUBLE))::DOUBLE AS score FROM g)
SELECT provider, success, failure, rate_limits, round(score, 6) AS score,
  CASE WHEN score >= 0.9 THEN 'healthy' WHEN score >= 0.5 THEN 'limited' ELSE 'failing' END AS label FROM s""")
def provider_health(spark, sf):
    return observe.provider_health(S.calls(spark, sf)).withColumn("score", F.round("score", 6))


def log_lines(spark, sf):
    e = S.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    msg = (
        F.when((F.col("event_type") == "error") & (k < 50), "API 错误 状态码: 429")
        .when(F.col("event_type") == "error", "[降级] Provider m 连续 429 3 次 状态码: 429")
        .when(F.col("event_type") == "signup", F.when(k < 50, "状态码: 503").otherwise("API 超时"))
        .when((F.col("event_type") == "purchase") & (k < 5), "状态码: 401").otherwise("ok"))
    return e.select(F.concat_ws(" ", F.col("event_id").cast("string"), msg).alias("line"))


LOG = """lines AS (SELECT event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT 'rate_limit' AS kind, count(*) FILTER (t = 'error') AS n FROM lines
  UNION ALL SELECT 'server_error', count(*) FILTER (t = 'signup' AND k < 50) FROM lines
  UNION ALL SELECT 'timeout', count(*) FILTER (t = 'signup' AND k >= 50) FROM lines
  UNION ALL SELECT 'network_error', 0 UNION ALL SELECT 'server_degradation', 0
  UNION ALL SELECT 'auth_error', count(*) FILTER (t = 'purchase' AND k < 5) FROM lines
  UNION ALL SELECT 'degradation', count(*) FILTER (t = 'error' AND k >= 50) FROM lines)"""


@query("log_counts", f"WITH {LOG} SELECT kind, n FROM n")
def log_counts(spark, sf):
    return observe.log_counts(log_lines(spark, sf))


@query("log_triage", f"""WITH {LOG} SELECT kind, CASE kind WHEN 'auth_error' THEN 'CRITICAL' WHEN 'degradation' THEN 'HIGH'
  WHEN 'rate_limit' THEN CASE WHEN n > 10 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'MEDIUM' END AS severity, n
FROM n WHERE n > 0 AND kind <> 'network_error'""")
def log_triage(spark, sf):
    return observe.log_triage(log_lines(spark, sf))


STREAKS = f"""{CALLS}, isl AS (SELECT *, sum(CAST(outcome = 'ok' AS INTEGER)) OVER w AS g FROM calls WINDOW w AS (PARTITION BY provider ORDER BY ts, seq)),
st AS (SELECT provider, ts, seq, outcome, CAST(sum(CAST(outcome = 'rate_limit' AS INTEGER)) OVER w AS BIGINT) AS rate_limit,
  CAST(sum(CAST(outcome = 'server_error' AS INTEGER)) OVER w AS BIGINT) AS server_error FROM isl WINDOW w AS (PARTITION BY provider, g ORDER BY ts, seq)),
cd AS (SELECT *, CASE outcome WHEN 'rate_limit' THEN CASE WHEN rate_limit >= 3 THEN 300 ELSE 30 END
  WHEN 'server_error' THEN CASE WHEN server_error >= 3 THEN 120 ELSE 15 END ELSE 0 END AS cooldown FROM st)"""


@query("failure_streaks", f"WITH {STREAKS} SELECT provider, seq, outcome, rate_limit, server_error, CAST(cooldown AS INTEGER) AS cooldown FROM cd")
def failure_streaks(spark, sf):
    return observe.failure_streaks(S.calls(spark, sf)).select("provider", "seq", "outcome", "rate_limit", "server_error", "cooldown")


@query("provider_availability", f"""WITH {STREAKS}, l AS (SELECT provider, arg_max(rate_limit, seq) AS rate_limit, arg_max(server_error, seq) AS server_error,
  max(seq) FILTER (outcome <> 'other_error') AS at FROM cd GROUP BY 1)
SELECT l.provider, l.rate_limit, l.server_error, CASE WHEN cd.outcome <> 'ok' THEN CAST(epoch(date_trunc('second', ts)) + cooldown AS BIGINT) END AS open_until
FROM l LEFT JOIN cd ON cd.provider = l.provider AND cd.seq = l.at""")
def provider_availability(spark, sf):
    a = observe.availability(observe.failure_streaks(S.calls(spark, sf)))
    return a.withColumn("open_until", F.unix_timestamp("open_until"))


# ---- queue ----------------------------------------------------------------------------------

def outcomes(spark, sf):
    e = S.table(spark, sf, "events")
    o = (F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "cancel")
         .when(F.col("event_type") == "click", "processing").otherwise("done"))
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ord"), o.alias("outcome"))


def tasks(spark, sf):
    """One pending task per user with events."""
    c = S.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("seq"))
    path = F.col("user_id").cast("string")
    return c.select(F.substring(F.md5(path.cast("binary")), 1, 8).alias("task_id"), path.alias("path"),
                    C("pending").alias("status"), C(0).cast("bigint").alias("retry_count"), "seq")


QUEUE = """o AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS ord, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel'
  WHEN 'click' THEN 'processing' ELSE 'done' END AS outcome FROM events),
l AS (SELECT path, min(ord) AS seq, count(*) FILTER (outcome = 'fail') AS retry_count,
  coalesce(arg_max(outcome, ord) FILTER (outcome <> 'cancel'), 'none') AS act, coalesce(max(ord) FILTER (outcome <> 'cancel'), -1) AS act_at,
  coalesce(max(ord) FILTER (outcome = 'cancel'), -1) AS cancel_at FROM o GROUP BY 1),
s AS (SELECT *, CASE act WHEN 'done' THEN 'done' WHEN 'processing' THEN 'processing'
  WHEN 'fail' THEN CASE WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END ELSE 'pending' END AS state FROM l),
q AS (SELECT substr(md5(path), 1, 8) AS task_id, path, seq, retry_count,
  CASE WHEN cancel_at > act_at AND state IN ('pending', 'processing') THEN 'cancelled' ELSE state END AS status FROM s)"""


@query("queue_transitions", f"WITH {QUEUE} SELECT task_id, path, status, retry_count, seq FROM q")
def queue_transitions(spark, sf):
    return work_queue.apply_outcomes(tasks(spark, sf), outcomes(spark, sf))


@query("queue_summary", f"""WITH {QUEUE} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled, bool_and(status IN ('done', 'cancelled', 'failed')) AS is_empty,
  arg_min(path, seq) FILTER (status = 'pending') AS next_pending FROM q""")
def queue_summary(spark, sf):
    return work_queue.summary(work_queue.apply_outcomes(tasks(spark, sf), outcomes(spark, sf)))


@query("queue_retry", f"""WITH {QUEUE} SELECT path, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status,
  CASE status WHEN 'failed' THEN 0 ELSE retry_count END AS retry_count FROM q WHERE status NOT IN ('done', 'cancelled')""")
def queue_retry(spark, sf):
    q = work_queue.apply_outcomes(tasks(spark, sf), outcomes(spark, sf))
    return work_queue.clear_completed(work_queue.retry_failed(q)).select("path", "status", "retry_count")


@query("queue_enqueue", """WITH b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events),
f AS (SELECT CAST(o_custkey AS VARCHAR) AS path, min(o_orderkey) AS seq FROM orders GROUP BY 1)
SELECT substr(md5(path), 1, 8) AS task_id, path, 'pending' AS status, 0::BIGINT AS retry_count FROM (
  SELECT path FROM b UNION SELECT path FROM f)""")
def queue_enqueue(spark, sf):
    """Customers with orders join the queue of users; each path once."""
    files = S.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("seq"))
    return work_queue.enqueue(tasks(spark, sf), files).select("task_id", "path", "status", "retry_count")


# ---- repair ------------------------------------------------------------------------------------

def placed(spark, sf):
    """Pages by language; their sources sit in folders by language/source."""
    d = S.table(spark, sf, "documents")
    name = F.concat(C("d"), F.col("doc_id").cast("string"))
    return d.select(
        F.concat_ws("/", F.when(F.col("n_chars") >= 1000, F.concat_ws("/", "lang", "source")).otherwise(F.col("lang")),
                    F.concat(name, C(".md"))).alias("rel_path"),
        F.concat(C("---\ncategory: "), "lang", C("\noriginal_path: source/"), F.concat_ws("/", "lang", "source"), C("/"), name, C(".pdf\n---\n")).alias("content"),
        F.concat_ws("/", "lang", "source", F.concat(name, C(".pdf"))).alias("file"), "doc_id")


@query("align_plan", """WITH p AS (SELECT 'd' || doc_id || '.md' AS f, CASE WHEN n_chars >= 1000 THEN lang || '/' || source ELSE lang END AS dir,
  lang || '/' || source AS want FROM documents)
SELECT dir || '/' || f AS rel_path, want || '/' || f AS target, CASE WHEN dir = want THEN 'skip' ELSE 'move' END AS action FROM p""")
def align_plan(spark, sf):
    p = placed(spark, sf)
    return repair.align_plan(p, p.select(F.col("file").alias("rel_path")))


@query("repair_plan", """WITH p AS (SELECT 'd' || doc_id || '.md' AS f, CASE WHEN n_chars >= 1000 THEN lang || '/' || source ELSE lang END AS dir,
  lang AS old, lang || '/' || source AS want FROM documents)
SELECT dir || '/' || f AS rel_path, old AS old_category, want AS category, true AS fix_category, dir <> want AS fix_dir,
  CASE WHEN dir <> want THEN 'move' ELSE 'rewrite' END AS action FROM p""")
def repair_plan(spark, sf):
    p = placed(spark, sf)
    files = p.select(F.col("file").alias("rel_path"), F.concat(C("x/"), "file").alias("vault_path"))
    return repair.repair_plan(p, files)


@query("repair_apply", """SELECT lang || '/' || source || '/d' || doc_id || '.md' AS rel_path,
  '---' || chr(10) || 'category: ' || lang || '/' || source || chr(10) || 'original_path: source/' || lang || '/' || source || '/d' || doc_id || '.pdf' || chr(10) || '---' || chr(10) AS content
FROM documents""")
def repair_apply(spark, sf):
    p = placed(spark, sf)
    files = p.select(F.col("file").alias("rel_path"), F.concat(C("x/"), "file").alias("vault_path"))
    return repair.apply_repair(p.select("rel_path", "content"), repair.repair_plan(p, files))


@query("reconcile", """SELECT CASE WHEN n_chars >= 1000 THEN lang || '/' || source ELSE lang END || '/d' || doc_id || '.md' AS rel_path,
  lang || '/' || source || '/d' || doc_id || '.pdf' AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def reconcile(spark, sf):
    """Only labelled documents still have their source file."""
    p = placed(spark, sf)
    files = p.join(S.table(spark, sf, "labels"), "doc_id", "left_semi").select(F.col("file").alias("rel_path"))
    return repair.reconcile(p, files)


@query("unsupported_evidence", rf"""WITH {WEB}, f AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS category,
  regexp_replace(regexp_extract(path, '[^/]*$'), '([^.])\.[^.]+$', '\1') AS stem, regexp_extract(path, '[^/.](\.[^./]+)$', 1) AS ext FROM web)
SELECT category, stem, ext, count(*) * 2 AS n FROM f GROUP BY ALL""")
def unsupported_evidence(spark, sf):
    """The same pages from the run's list and from the status table."""
    w = S.web_pages(spark, sf).select("path", P.dirname("path").alias("category"), P.suffix("path").alias("ext"))
    e = moc.unsupported_evidence(w, incremental.register_unsupported(w), None)
    return e.groupBy("category", "stem", "ext").agg(F.count("*").alias("n"))


