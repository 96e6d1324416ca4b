"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of the schedule takes the point frac(j * golden ratio), mapped through
the cumulative target weights to a source; the r-th slot of a source takes the
r-th block of that source's stream. A stream is the source's documents in a
keyed shuffle, passed up to ``max_repeats`` times and cut into blocks of equal
size. Slots are a fixed number, so a block grows with the corpus and every
source comes within a few blocks of its target at any prefix of the schedule.
Where blocks are longer than a word, a source whose target is few of them takes
its target by words from the head of its stream instead: a few blocks more or
less would be much of it, or all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..session import settle, settle_table

GOLDEN = 0.6180339887498949
SLOTS = 1 << 20
#: A target of fewer blocks is taken by words; beyond it a few blocks are a thousandth.
FEW_BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source whose running sum is one task's work, on average.
PER_BUCKET = 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: int = 3, max_repeats: int = 3) -> DataFrame:
    """(src, source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, ... ``weights``, repeating,
    and share the sum of all sizes. A target stops at ``max_repeats`` times the
    source's size; the excess is shared again by weight until none is above.
    """
    named = sizes.withColumn("none", F.col("source").isNull())
    s = settle(
        global_rank(named, ["none", "source"], "src")
        .select("src", "source", "source_size", ((F.col("src") - 1) % weights + 1).alias("w"),
                (F.col("source_size") * max_repeats).alias("cap"))
    )
    level, before = 0.0, -1
    while True:  # each round caps at least one more source
        above = F.col("cap") < F.lit(level) * F.col("w")
        r = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("capped"),
                  F.sum(F.when(above, 0).otherwise(F.col("w"))).alias("w"), F.count_if(above).alias("n")).first()
        if r["n"] == before or not r["w"]:
            break
        before, level = r["n"], (r["total"] - r["capped"]) / r["w"]
    return s.select("src", "source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def schedule(goal: DataFrame, total: int, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(slot, src, block) of every slot, and the words of a block.

    ``goal``: (src, target). At most ``slots`` rows, whatever the size.
    """
    spark = goal.sparkSession
    block = max(1, -(-total // slots))
    bins = 4096
    w = Window.orderBy("bin0").rowsBetween(Window.unboundedPreceding, -1)
    # cumulative weights: within ranges of 4096 sources, then over the ranges
    part = goal.filter("target > 0").withColumn("bin0", F.floor(F.col("src") / 4096))
    inner = Window.partitionBy("bin0").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("bin0").agg(F.sum("target").alias("t")).select("bin0", F.coalesce(F.sum("t").over(w), F.lit(0.0)).alias("base"))
    cum = part.join(base, "bin0").select("src", (F.col("base") + F.coalesce(F.sum("target").over(inner), F.lit(0.0))).alias("lo"), "target")
    share = cum.select("src", (F.col("lo") / float(max(total, 1))).alias("lo"), ((F.col("lo") + F.col("target")) / float(max(total, 1))).alias("hi"))
    share = settle(share)
    spread = share.select("src", "lo", "hi", F.explode(F.sequence(
        F.least(F.floor(F.col("lo") * bins), F.lit(bins - 1)), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))).alias("bin"))
    point = spark.range(total // block).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)).alias("u"))
    placed = (
        point.withColumn("bin", F.floor(F.col("u") * bins)).join(spread, "bin")
        .filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "src")
    )
    rank = F.row_number().over(Window.partitionBy("src").orderBy("slot"))
    return placed.withColumn("block", (rank - 1).cast("bigint")), block


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: int = 3,
        max_repeats: int = 3, slots: int = SLOTS) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    size: words of the text, a null text has 0; taken: words that the mix takes
    of the row, repeats counted, at most ``max_repeats`` * size. A null source
    is a source of its own. Rows that repeat an id or have a null id are mixed
    one by one. The shuffle is keyed by the
    id, so a rerun gives the same mix. An empty table gives an empty result.
    Every source takes its target to within a few blocks, or to the word where
    that is under FEW_BLOCKS of more than a word each.
    """
    return _mix(docs, F.monotonically_increasing_id(), id_col, text_col, source_col, weights, max_repeats, slots).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, uid: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: int = 3,
         max_repeats: int = 3, slots: int = SLOTS) -> DataFrame:
    """(uid, id, size, source_size, target, taken); ``uid`` tells rows apart."""
    base = settle(docs.select(
        uid.alias("uid"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"), F.md5(F.concat(F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")))
    goal = settle(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    plan, block = schedule(goal.select("src", "target"), total, slots)
    plan = settle(plan)
    took = plan.groupBy("src").agg((F.max("block") + 1).alias("blocks"))

    buckets = max(1, -(-rows // PER_BUCKET))
    few = F.lit(block > 1) & (F.col("target") < FEW_BLOCKS * block)
    own = goal.join(took, "src", "left").select("src", F.col("source").alias("named"), "source_size", "target",
                                                F.coalesce("blocks", F.lit(0)).alias("blocks"),
                                                F.when(few, F.round("target").cast("bigint")).alias("words"))
    d = base.join(own, F.col("source").eqNullSafe(F.col("named"))).withColumn(
        "bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets))
    sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("from"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = settle(
        d.withColumn("end", F.sum("size").over(inside)).join(sums, ["src", "bucket"])
        .select("uid", "id", "src", "size", "source_size", "target", "blocks", "words", (F.col("from") + F.col("end") - F.col("size")).alias("start"))
    )
    passes = placed.filter("size > 0 and blocks > 0 and words is null").select(
        "uid", "src", "size", "blocks", F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: e * F.col("source_size") + F.col("start"))).alias("lo"))
    first, last = F.floor(F.col("lo") / block), F.least(F.floor((F.col("lo") + F.col("size") - 1) / block), F.col("blocks") - 1)
    pieces = passes.filter(first < F.col("blocks")).select("uid", "src", "lo", "size", F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("lo"), F.col("block") * block)
    taken = pieces.join(plan, ["src", "block"]).groupBy("uid").agg(F.sum(overlap).alias("taken"))
    # sources of few blocks: what each pass over the stream has of the row before the target is reached
    by_words = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - e * F.col("source_size") - F.col("start")))
                    for e in range(max_repeats)), F.lit(0))
    return placed.join(taken, "uid", "left").select(
        "uid", "id", "size", "source_size", "target",
        F.when(F.col("words").isNotNull(), by_words).otherwise(F.coalesce("taken", F.lit(0))).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as whole documents: each row ``round(taken / size)`` times.

    Rows without words stay once. Same columns as ``docs``. Rows that repeat
    an id or have a null id count one by one: the rows are written once with
    numbers of their own, which the mix and the join back both read.
    """
    rows = settle_table(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    got = _mix(rows.select("row.*", F.col("uid").alias("_mix_uid")), F.col("_mix_uid"), id_col, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    out = rows.join(got.select("uid", times.alias("times")).filter("times > 0"), "uid")
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
