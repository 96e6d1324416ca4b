"""Run, provider and log health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..plans.scan import running_streaks


def run_counters() -> list[Column]:
    s = F.col("status")
    return [
        F.count("*").alias("processed"), F.count_if(s == "ok").alias("succeeded"),
        F.count_if(s == "fail").alias("failed"), F.count_if(s == "skip").alias("skipped"),
        F.sum("elapsed").alias("elapsed"),
    ]


def with_health(counts: DataFrame, limit: float = 0.5) -> DataFrame:
    """Adds fail_rate and healthy (more than ``limit`` failed is unhealthy)."""
    rate = F.coalesce(F.try_divide("failed", "processed"), F.lit(0.0))
    return counts.withColumn("fail_rate", rate).withColumn("healthy", ~(rate > limit))


def run_health(file_events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and health per run. file_events: file, status, elapsed, …"""
    return with_health(file_events.groupBy(*(by or [])).agg(*run_counters()))


def run_errors(file_events: DataFrame) -> DataFrame:
    """Failed files with their error."""
    return file_events.filter("status = 'fail'").select("file", F.col("detail").alias("error"), F.round("elapsed", 2).alias("elapsed"))


def usage_totals(calls: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "ok"
    return calls.agg(
        F.count_if(ok).alias("api_calls"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("latency"))), F.lit(0.0)).alias("total_latency"),
        F.avg(F.when(ok, F.col("latency"))).alias("avg_latency"),
        F.count_if(~ok).alias("errors"),
    )


def provider_health(calls: DataFrame) -> DataFrame:
    """provider, success, failure, rate_limits, score, label."""
    ok = F.col("outcome") == "ok"
    g = calls.groupBy("provider").agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"),
        F.count_if(F.col("outcome") == "rate_limit").alias("rate_limits"))
    total = F.col("success") + F.col("failure")
    score = F.when(total == 0, 1.0).otherwise(F.greatest(
        F.lit(0.0), F.col("success") / total - F.least(F.lit(0.5), F.col("rate_limits") / total * 2)))
    label = F.when(total == 0, "unused").when(score >= 0.9, "healthy").when(score >= 0.5, "limited").otherwise("failing")
    return g.withColumn("score", score).withColumn("label", label)


def log_counts(lines: DataFrame, patterns: dict[str, str] = K.LOG_PATTERNS) -> DataFrame:
    """kind, n: lines per class; a line may count in several."""
    one = lines.agg(*[F.count_if(F.col("line").rlike(p)).alias(k) for k, p in patterns.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in patterns])
    return one.select(F.explode(rows).alias("r")).select("r.kind", "r.n")


SEVERITY = {
    "auth_error": "CRITICAL", "degradation": "HIGH", "server_degradation": "MEDIUM", "timeout": "MEDIUM",
    "server_error": "MEDIUM",
}


def log_triage(lines: DataFrame, patterns: dict[str, str] = K.LOG_PATTERNS, many: int = 10) -> DataFrame:
    """kind, severity, n of the problems found; one OK row without any.

    Network errors count towards "any problem" but have no row of their own.
    """
    c = log_counts(lines, patterns)
    sev = F.lit(None).cast("string")
    for k, v in SEVERITY.items():
        sev = F.when(F.col("kind") == k, v).otherwise(sev)
    sev = F.when(F.col("kind") == "rate_limit", F.when(F.col("n") > many, "HIGH").otherwise("MEDIUM")).otherwise(sev)
    found = c.filter("n > 0").select("kind", sev.alias("severity"), "n").filter("severity IS NOT NULL")
    fine = c.agg(F.sum("n").alias("t")).filter("t = 0").select(
        F.lit("none").alias("kind"), F.lit("OK").alias("severity"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(fine)


def cooldown_seconds(limit: int = K.STREAK_LIMIT, rules: dict = K.COOLDOWN) -> Column:
    """Seconds a provider rests after a call, from its streak columns."""
    out = F.lit(0)
    for kind, (short, long) in rules.items():
        out = F.when(F.col("outcome") == kind, F.when(F.col(kind) >= limit, long).otherwise(short)).otherwise(out)
    return out


def failure_streaks(calls: DataFrame, piece_seconds: int = 3600, initial: DataFrame | None = None) -> DataFrame:
    """Each call with its running 429 and 5xx streaks and the resulting rest.

    A success resets both streaks, other errors leave them. calls: provider,
    ts, seq, outcome. Long histories are scanned in pieces of
    ``piece_seconds``; ``initial`` holds streaks from earlier calls.
    """
    kinds = {k: F.col("outcome") == k for k in K.COOLDOWN}
    piece = F.floor(F.unix_timestamp("ts") / piece_seconds)
    rows = calls.select("provider", "ts", "seq", "outcome")
    out = running_streaks(rows, "provider", ["ts", "seq"], piece, F.col("outcome") == "ok", kinds, initial)
    return out.withColumn("cooldown", cooldown_seconds())


def availability(streaks: DataFrame) -> DataFrame:
    """provider, open_until, consecutive counts after the last call."""
    last = F.struct("ts", "seq")
    # the rest ends with the next success; other errors leave it running
    acts = F.col("outcome").isin("ok", *K.COOLDOWN)
    until = F.when(F.col("outcome") == "ok", F.lit(None)).otherwise(
        F.timestamp_seconds(F.unix_timestamp("ts") + F.col("cooldown")))
    return streaks.withColumn("_u", until).groupBy("provider").agg(
        F.max_by("_u", F.when(acts, last)).alias("open_until"),
        *[F.max_by(k, last).alias(k) for k in K.COOLDOWN])
