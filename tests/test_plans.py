"""Plans have the shape the operators rely on."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import incremental
from corpusloom.plans.joins import attach
from corpusloom.plans.ranking import top_k
from corpusloom.sources import corpus as S

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    p = plan(top_k(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.col("id").desc()], 5))
    assert p.count("WindowGroupLimit") == 2 and p.index("WindowGroupLimit") < p.index("Exchange")


def test_hashing_reads_one_column_and_pushes_filters(spark):
    d = S.table(spark, SF, "documents").filter("lang = 'en'")
    p = plan(incremental.exact_groups(d, "doc_id", "text"))
    assert "EqualTo(lang,en)" in p and "source" not in p.split("ReadSchema")[1]


def test_small_facts_leave_wide_rows_in_place(spark):
    wide = spark.range(1000).withColumn("content", F.repeat(F.lit("x"), 100))
    facts = spark.range(0, 1000, 50).withColumn("v", F.lit(1))
    assert "BroadcastHashJoin" in plan(attach(wide, facts, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        big = attach(wide, facts, "id", max_bytes=10)
        assert "Broadcast" not in plan(big) and big.filter("v = 1").count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [
    "skip_known", "broken_links", "cascade_plan", "subtree_counts", "topic_assign_blocks", "topic_merge_pairs",
    "topic_keyword_assign", "failure_streaks", "queue_transitions", "classify_dynamic", "dup_page_pairs"])
def test_no_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
