import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from querylume.functions import casts, lists
from querylume.operators.cleaning import clean_log, conform
from querylume.operators.explode import explode_accesses, explode_ids, explode_read_write
from querylume.operators import projections
from querylume.schema import RAW_ONLY_COLUMNS, TEXT_SCHEMA


def values(df):
    return [r[0] for r in df.collect()]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("2.0",), ("NaN",), ("x",), ("",), (None,)], "v string")
    nums = values(df.select(casts.nan_to_null(casts.to_num_lenient(F.col("v")))))
    assert nums == [2.0, None, None, None, None]
    stamps = spark.createDataFrame(
        [("2024-01-01T00:00:01",), ("2024-13-01",), ("soon",), (None,)], "v string")
    assert values(stamps.select(casts.to_ts_lenient(F.col("v")))) == [
        datetime.datetime(2024, 1, 1, 0, 0, 1), None, None, None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_cast_fails_on_a_bad_value(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        good = spark.createDataFrame([("2024-01-01",), (None,)], "v string")
        assert values(good.select(casts.to_ts_strict(F.col("v")))) == [
            datetime.datetime(2024, 1, 1), None]
        bad = spark.createDataFrame([("2024-01-01",), ("soon",)], "v string")
        with pytest.raises(PySparkException, match="not a timestamp: soon"):
            bad.select(casts.to_ts_strict(F.col("v"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_whole_numbers_from_text(spark):
    given = ["7", "7.0", '"NaN"', "7.5", "x", None, "9007199254740993", "1e20"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    got = values(df.select(casts.to_int_lenient(F.col("v"))))
    assert got == [7, 7, None, None, None, None, 9007199254740993, None]


def test_conform_types_text_rows(spark):
    row = ("1", "2.0", "2024-01-01T00:00:00", '"NaN"', "12.5", "1", "select", "1", None, "x", None)
    typed = conform(spark.createDataFrame([row], TEXT_SCHEMA)).first()
    assert tuple(typed) == (
        1, 2, datetime.datetime(2024, 1, 1), None, 12.5, 1, "select", "1", None, None, None)


def test_clean_log_keeps_valid_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("soon", 2), (None, 3)], "t string, n int")
    assert [r.n for r in clean_log(df, "t").collect()] == [1]


def test_explode_of_empty_and_repeated_lists(spark):
    df = spark.createDataFrame(
        [(1, None), (2, ""), (3, "1"), (4, "1,1"), (5, "00,5")], "id int, l string")
    got = sorted((r.id, r.table_id) for r in explode_ids(df, "l", keep=["id"]).collect())
    assert got == [(3, "1"), (4, "1"), (4, "1"), (5, "00"), (5, "5")]


def test_explode_read_write_sides(make_log):
    log = make_log(
        {"read_table_ids": "1", "write_table_ids": "2"},
        {"read_table_ids": "1", "write_table_ids": None},
        {"read_table_ids": None, "write_table_ids": "3"},
        {"read_table_ids": "4,4", "write_table_ids": "4"},
        {"read_table_ids": None, "write_table_ids": None},
    )

    def pairs(df):
        return sorted((r.query_id, r.table_id) for r in df.collect())

    assert pairs(explode_read_write(log)) == [(1, "1"), (1, "2"), (4, "4"), (4, "4"), (4, "4")]
    assert pairs(explode_read_write(log, once=True)) == [(1, "1"), (1, "2"), (4, "4")]
    assert pairs(explode_read_write(log, include_one_sided=True)) == [
        (1, "1"), (1, "2"), (2, "1"), (3, "3"), (4, "4"), (4, "4"), (4, "4")]


def test_accesses_in_one_scan_equal_the_union(make_log):
    log = make_log(
        {}, {"read_table_ids": "", "write_table_ids": "7"}, {"read_table_ids": None},
        {"read_table_ids": "5,5", "write_table_ids": "5"},
    )
    union = projections.union_all(
        explode_ids(log, "read_table_ids", keep=["query_id"]),
        explode_ids(log, "write_table_ids", keep=["query_id"]),
    )
    single = explode_accesses(log, ["query_id"])
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, union.collect()))


def test_joining_messages_skips_nulls(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "a string, b string, c string")
    assert values(df.select(lists.join_texts([F.col("a"), F.col("b"), F.col("c")]))) == ["a | c", ""]


def test_projections(spark, make_log):
    raw = make_log({}).withColumns({c: F.lit(0) for c in RAW_ONLY_COLUMNS})
    assert projections.drop_raw_only(raw).columns == make_log({}).columns
    with pytest.raises(ValueError, match="missing columns: nope"):
        projections.project(raw, ["query_id", "nope"])
    labels = {"0": "Not Cached", "1": "Cached"}
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "v int")
    assert values(df.select(projections.relabel(F.col("v"), labels))) == [
        "Not Cached", "Cached", "2", None]
