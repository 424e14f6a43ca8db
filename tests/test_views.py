import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import first_plan
from querylume.fixture import query_log
from querylume.operators.aggregation import share_of_total
from querylume.operators.joins import HOT_FRACTION, join_unique
from querylume.plans import views

SF = "/root/testdata/sf0.001"


def test_access_shares_add_up(spark):
    m1 = views.table_access_daily(query_log(spark, SF))
    by_day = m1.groupBy("day").agg(F.sum("percentage").alias("p")).collect()
    assert by_day and all(abs(r.p - 100) < 1e-6 for r in by_day)
    assert abs(m1.agg(F.sum("overall_percentage")).first()[0] - 100) < 1e-6


def test_type_shares_add_up(spark):
    m3 = views.query_types_daily(query_log(spark, SF))
    by_day = m3.groupBy("day").agg(F.sum("daily_percentage").alias("p")).collect()
    assert by_day and all(abs(r.p - 100) < 1e-6 for r in by_day)


def test_a_type_with_a_comma_counts_as_two(make_log):
    got = views.query_types_daily(make_log({"query_type": "select,copy"})).collect()
    assert sorted((r.query_type, r.daily_percentage) for r in got) == [
        ("copy", 50.0), ("select", 50.0)]


def test_hit_rates_of_a_day_add_up_to_its_rate(make_log):
    log = make_log(
        {"was_cached": 1}, {"was_cached": 0, "user_id": 2}, {"was_cached": 1, "user_id": 2},
        {"was_cached": None, "query_type": "copy"})
    got = views.hit_rate_daily(log).collect()
    assert sum(r.hit_rate_per_day for r in got) == pytest.approx(50.0)
    assert {r.total_queries for r in got} == {4}


def test_compile_means_skip_null_nan_and_other_types(make_log):
    log = make_log(
        {"compile_duration_ms": 2.0}, {"compile_duration_ms": 4.0, "query_type": "SELECT"},
        {"compile_duration_ms": None}, {"compile_duration_ms": float("nan")},
        {"query_type": "copy", "compile_duration_ms": 100.0}, {"num_joins": None},
        {"num_joins": 7, "compile_duration_ms": None})
    assert sorted(map(tuple, views.compile_by_joins(log).collect())) == [(2, 3.0), (7, None)]
    stored = views.compile_means(views.compile_counts(log))
    assert sorted(map(tuple, stored.collect())) == [(2, 3.0), (7, None)]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_access_rows_with_a_hot_table(spark, threshold):
    """A third of all accesses go to one table on one day."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(40)}") for i in range(6000)]
    log = spark.createDataFrame(rows, "query_id long, read_table_ids string").select(
        "query_id", F.lit("2024-01-01").cast("timestamp").alias("arrival_timestamp"),
        "read_table_ids", F.lit(None).cast("string").alias("write_table_ids"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = views.table_access_rows(log)
        got = Counter((r.table_id, r["count"], r.percentage) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = Counter(t for _, t in rows)
    assert got == {(t, n, n / 6000 * 100): n for t, n in counts.items()}


def test_hot_rows_are_dealt_over_partitions(spark):
    """Without a broadcast, rows of the hot key end up in many shuffle partitions."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_unique(rows, lookup, ["k"], "n")
        spread = joined.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        total = joined.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert total == 9000
    assert len(spread) == 8 and max(r["count"] for r in spread) < 3000 / 2
    assert HOT_FRACTION == 1000


def test_shares_within_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "k string, n int")
    got = {(r.k, r.n): r.share for r in share_of_total(df, "n", by=["k"]).collect()}
    assert got == {("a", 1): 25.0, ("a", 3): 75.0, (None, 5): 100.0}


def test_the_access_summary_shuffles_log_rows_once(spark):
    """One shuffle by group; the other exchanges hold one row per day and task, and the
    window runs over one row per day."""
    plan = first_plan(views.table_access_daily(query_log(spark, SF)))
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line
            and "table_id" in line]
    assert len(wide) == 1
    assert plan.count("Window [") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    below = plan.split("Window [", 1)[1]
    assert "keys=[day" in below.split("FileScan")[0] and "keys=[day#" in below


def test_shares_from_a_log_and_from_stored_counts_agree(spark):
    log = query_log(spark, SF)
    for daily, (counts, shares) in [
        (views.table_access_daily, views.SUMMARIES["table_access"]),
        (views.query_types_daily, views.SUMMARIES["query_types"]),
        (views.hit_rate_daily, views.SUMMARIES["hit_rate"]),
    ]:
        assert sorted(map(str, daily(log).collect())) == sorted(map(str, shares(counts(log)).collect()))


def test_rows_without_a_timestamp_have_no_share_of_a_day(make_log):
    log = make_log({"arrival_timestamp": None}, {"read_table_ids": "3,4"})
    got = {(r.day is None, r.table_id): (r.percentage, r.overall_percentage)
           for r in views.table_access_daily(log).collect()}
    assert got == {(True, "1"): (None, 25.0), (True, "2"): (None, 25.0),
                   (False, "3"): (50.0, 25.0), (False, "4"): (50.0, 25.0)}


@pytest.mark.parametrize("view", [views.table_access_daily, views.query_types_daily, views.hit_rate_daily])
def test_a_summary_reads_the_log_twice(spark, view):
    """Once for its groups, once, narrowly, for the totals."""
    assert first_plan(view(query_log(spark, SF))).count("FileScan") == 2
