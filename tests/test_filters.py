import pytest

from conftest import final_plan
from querylume.operators import filters
from querylume.operators.projections import with_day


def ids(df):
    return sorted(r.query_id for r in df.collect())


@pytest.fixture
def log(make_log):
    stamps = ["2024-01-31T23:59:59", "2024-02-01T00:00:00", "2024-02-02T00:00:00",
              "2024-02-02T00:05:00", "2024-02-29T12:01:00", "2024-03-01T00:00:00"]
    return make_log(*[{"arrival_timestamp": s, "user_id": i % 2, "query_type": t}
                      for i, (s, t) in enumerate(zip(stamps, ["select", "SELECT", "copy"] * 2))])


def test_a_timestamp_range_ends_at_midnight_but_a_day_range_does_not(log):
    assert ids(filters.between_ts(log, "2024-02-01", "2024-02-02")) == [2, 3]
    assert ids(filters.between_days(with_day(log), "2024-02-01", "2024-02-02")) == [2, 3, 4]


def test_open_ranges(log):
    assert ids(filters.between_ts(log, end="2024-02-01")) == [1, 2]
    assert ids(filters.between_days(with_day(log), start="2024-02-29")) == [5, 6]


def test_month_filter(log):
    assert ids(filters.in_month(log, "2024-02")) == [2, 3, 4, 5]
    assert ids(filters.in_month(with_day(log), "2024-02")) == [2, 3, 4, 5]


def test_latest_day(log, spark):
    assert ids(filters.latest_day(log)) == [6]
    assert ids(filters.latest_day(with_day(log))) == [6]
    days = with_day(log).select("day").distinct()
    assert ids(filters.latest_day(log, days=days)) == [6]


def test_optional_filters(log):
    assert ids(filters.where_optional(log)) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.where_optional(log, "All", "All")) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.where_optional(log, "select", 0)) == [1]
    assert ids(filters.where_optional(log, user_id=0)) == [1, 3, 5]


def test_type_filter_ignores_case(log):
    assert ids(filters.of_type(log, "Select")) == [1, 2, 4, 5]


def test_minutes_and_cursor(log):
    assert ids(filters.minute_multiple(log, 5)) == [2, 3, 4, 6]
    assert ids(filters.after(log, "2024-02-02 00:00:00")) == [4, 5, 6]


def test_present_skips_null_and_nan(make_log):
    log = make_log({}, {"compile_duration_ms": None}, {"compile_duration_ms": float("nan")},
                   {"num_joins": None})
    assert ids(filters.present(log, "compile_duration_ms", "num_joins")) == [1]


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", "ts")
    plan = final_plan(filters.between_ts(events, "2024-01-05", "2024-01-06", ts="ts"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "LessThanOrEqual(ts,2024-01-06" in plan


def test_a_timestamp_range_prunes_days(spark, log, tmp_path):
    path = str(tmp_path / "log")
    with_day(log).write.partitionBy("day").parquet(path)
    picked = filters.between_ts(spark.read.parquet(path), "2024-02-01", "2024-02-02")
    plan = final_plan(picked)
    assert ids(picked) == [2, 3]
    assert "PartitionFilters: [isnotnull(day" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("2024-02-01" in line for line in scans)


def test_a_query_type_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("select",), ("SELECT",), ("Select",), ("copy",)], "query_type string").write.parquet(path)
    rows = filters.of_type(spark.read.parquet(path), "sElect")
    assert rows.count() == 3
    assert "PushedFilters: [GreaterThanOrEqual(query_type" in rows._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(query_type), ", "")


SPELLINGS = ["select", "SELECT", "Select", "sElect", "SeLeCt", "selects", "copy", None, "selec", "sELECT"]


def test_all_spellings_of_a_type_are_found(make_log):
    log = make_log(*[{"query_type": t} for t in SPELLINGS])
    for asked in ("select", "SELECT", "sElEcT"):
        assert ids(filters.of_type(log, asked)) == [1, 2, 3, 4, 5, 10]
    stored = log.withColumn("type_key", filters.type_key(log.query_type))
    assert ids(filters.of_type(stored, "Select")) == [1, 2, 3, 4, 5, 10]
    odd = make_log({"query_type": "Prüfen"}, {"query_type": "PRÜFEN"}, {"query_type": "prufen"})
    assert ids(filters.of_type(odd, "prüFEN")) == [1, 2]


def test_the_scan_sees_the_type(spark, make_log, tmp_path):
    log = make_log(*[{"query_type": t} for t in SPELLINGS])
    log.write.parquet(f"{tmp_path}/raw")
    log.withColumn("type_key", filters.type_key(log.query_type)).write.parquet(f"{tmp_path}/stored")
    raw = filters.of_type(spark.read.parquet(f"{tmp_path}/raw"), "Select")
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(query_type,SELECT), LessThanOrEqual(query_type,select)" in plan
    stored = filters.of_type(spark.read.parquet(f"{tmp_path}/stored"), "Select")
    assert "EqualTo(type_key,select)" in stored._jdf.queryExecution().executedPlan().toString()
