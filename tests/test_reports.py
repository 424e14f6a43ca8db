import datetime

import pytest
from pyspark.sql import functions as F

from querylume.operators.ordering import recent, sample_n
from querylume.plans import reports, views

D = datetime.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_empty_hours_count_zero(make_log):
    log = make_log({"arrival_timestamp": "2024-01-01T22:10:00"},
                   {"arrival_timestamp": "2024-01-02T01:59:00"},
                   {"arrival_timestamp": "2024-01-02T01:00:00"})
    got = sorted(rows(reports.hourly_counts(log)))
    assert [n for _, n in got] == [1, 0, 0, 2]
    assert got[1][0] == datetime.datetime(2024, 1, 1, 23)


def test_days_without_queries_are_kept_without_a_rate(make_log):
    log = make_log({"arrival_timestamp": "2024-01-01T10:00:00", "was_cached": 1},
                   {"arrival_timestamp": "2024-01-01T11:00:00"},
                   {"arrival_timestamp": "2024-01-03T10:00:00"})
    assert sorted(rows(reports.daily_hit_rate(log))) == [
        (D(2024, 1, 1), 1, 2, 50.0), (D(2024, 1, 2), 0, 0, None), (D(2024, 1, 3), 0, 1, 0.0)]


def test_rolling_mean_counts_gaps_as_zero(make_log):
    log = make_log(*[{"arrival_timestamp": f"2024-01-{d:02d}T10:00:00"} for d in (1, 3, 9)])
    log = log.withColumn("mbytes_scanned", F.lit(7.0)).withColumn(
        "mbytes_spilled", F.when(F.col("query_id") == 2, float("nan")).otherwise(14.0))
    got = sorted(rows(reports.rolling_scan_spill(log)))
    assert len(got) == 9
    assert got[0][1:] == (7.0, 14.0)
    assert got[1][1:] == (3.5, 7.0)
    assert got[2][1:] == (pytest.approx(14 / 3), pytest.approx(14 / 3))
    assert got[8][1:] == (2.0, 2.0)


def test_headline_numbers(make_log):
    log = make_log({"was_cached": 1, "compile_duration_ms": float("nan")},
                   {"compile_duration_ms": None}, {"compile_duration_ms": 3.0},
                   {"arrival_timestamp": "2024-01-05T00:00:00"})
    assert rows(reports.headline(log)) == [(4, 25.0, 4.0, D(2024, 1, 5))]


def test_headline_of_nothing(make_log):
    empty = make_log({}).filter("false")
    assert rows(reports.headline(empty)) == [(0, None, None, None)]
    assert rows(reports.headline_range(empty)) == [(0, None, None, None)]


def test_most_frequent_type_is_the_smallest_on_ties_and_never_null(make_log):
    log = make_log({"query_type": "update"}, {"query_type": "copy"}, {"query_type": None},
                   {"query_type": None})
    assert reports.headline_range(log).first().most_frequent_query == "copy"


def test_distinct_queries_count_once(make_log):
    """Repeated ids and ids listed twice."""
    log = make_log(
        {"query_id": 1, "read_table_ids": "5,5", "write_table_ids": "5"},
        {"query_id": 1, "read_table_ids": "5", "write_table_ids": "6"},
        {"query_id": 2, "read_table_ids": "6", "write_table_ids": "7"})
    got = {r.table_id: (r["count"], r.overall_percentage)
           for r in reports.latest_table_share(log).collect()}
    assert got == {"5": (1, 50.0), "6": (2, 100.0), "7": (1, 50.0)}
    types = rows(reports.latest_type_share(log))
    assert types == [("select", 2, 100.0)]
    by_reads = rows(reports.top_tables_by_reads(log))
    assert by_reads == [("5", 3, 75.0), ("6", 1, 25.0)]
    by_queries = rows(reports.top_tables_by_queries(log))
    assert by_queries == [("5", 1, 50.0), ("6", 1, 50.0)]


def test_fifth_minutes_of_the_latest_day_only(make_log):
    log = make_log({"arrival_timestamp": "2024-01-01T10:05:00"},
                   {"arrival_timestamp": "2024-01-02T10:05:10", "was_cached": 1},
                   {"arrival_timestamp": "2024-01-02T10:05:50"},
                   {"arrival_timestamp": "2024-01-02T10:06:00"})
    assert rows(reports.fifth_minute_hit_rate(log)) == [
        (datetime.datetime(2024, 1, 2, 10, 5), 50.0)]


def test_top_tables_are_shares_of_what_was_picked(make_log):
    log = make_log({"read_table_ids": "1,2"}, {"read_table_ids": "1", "user_id": 2},
                   {"read_table_ids": "3", "arrival_timestamp": "2024-01-02T00:00:00"})
    m1 = views.table_access_daily(log)
    got = rows(reports.top_tables(m1, "2024-01-01", "2024-01-01", k=1))
    assert [(t, n) for t, n, _, _ in got] == [("1", 2)]
    assert got[0][3] == pytest.approx(200 / 3)
    mine = rows(reports.top_tables(m1, user_id=2))
    assert [(r[0], r[1], r[3]) for r in mine] == [("1", 1, 100.0)]


def test_recent_rows(make_log):
    log = make_log(*[{"arrival_timestamp": "2024-01-01T10:00:00"}] * 3,
                   {"arrival_timestamp": "2024-01-01T09:00:00"})
    assert rows(recent(log, 2, ["query_id", "was_cached"])) == [(3, 0), (2, 0)]


def test_sample_is_exact_repeatable_and_by_seed(spark):
    df = spark.range(50_000).withColumnRenamed("id", "query_id")
    first = {r.query_id for r in sample_n(df, 1000, 42).collect()}
    again = {r.query_id for r in sample_n(df.repartition(7), 1000, 42).collect()}
    other = {r.query_id for r in sample_n(df, 1000, 43).collect()}
    assert len(first) == 1000 and first == again and first != other
    plain = df.orderBy(F.md5(F.concat_ws(":", "query_id", F.lit("42")).cast("binary"))).limit(1000)
    assert first == {r.query_id for r in plain.collect()}
    assert sample_n(df.limit(10), 1000, 42).count() == 10


def test_sample_when_the_threshold_finds_too_few(spark):
    """All rows share one id, so all hashes are equal: the exact sort takes over."""
    df = spark.range(5000).select(F.lit(7).alias("query_id"), "id")
    drawn = sample_n(df, 100, 42).collect()
    assert len({r.id for r in drawn}) == 100


@pytest.mark.parametrize("first, last, hours", [
    ("2024-11-02T23:30:00", "2024-11-04T00:30:00", 27),
    ("2024-03-09T23:30:00", "2024-03-11T00:30:00", 25),
])
def test_hours_where_clocks_change(spark, first, last, hours):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        log = spark.createDataFrame([(1, first), (2, last)], "query_id long, t string").select(
            "query_id", F.col("t").cast("timestamp").alias("arrival_timestamp"))
        counts = [r.query_id for r in reports.hourly_counts(log).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(counts) == hours and sum(counts) == 2
