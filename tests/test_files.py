import datetime
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F, types as T

from querylume.fixture import query_log
from querylume.operators import ordering, windows
from querylume.plans.checks import sort_check
from querylume.session import scratch_path, shared_dir
from querylume.sources import files, jdbc

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def write(path, minutes, **options):
    stamps = [None if m is None else T0 + datetime.timedelta(minutes=m) for m in minutes]
    pq.write_table(pa.table({"ts": pa.array(stamps, pa.timestamp("us"))}), path, **options)


@pytest.mark.parametrize("parts, expected", [
    ([[1, 2, 3], [4, 5]], 0),
    ([[1, 3, 2], [4, 5]], 1),
    ([[1, 2, 6], [4, 5]], 1),
    ([[3, 2, 1], [0]], 3),
    ([[1, None, 0], [2]], 0),
    ([[5, 5, 5], [5]], 0),
])
def test_inversions_within_and_between_files(spark, tmp_path, parts, expected):
    for i, part in enumerate(parts):
        write(tmp_path / f"part-{i}.parquet", part)
    got = sort_check(spark, str(tmp_path), "ts").first()
    known = [m for p in parts for m in p if m is not None]
    assert got.out_of_order == expected
    assert got.first == T0 + datetime.timedelta(minutes=min(known))
    assert got.last == T0 + datetime.timedelta(minutes=max(known))


def test_a_file_cut_into_many_pieces_is_checked_as_one(spark, tmp_path):
    """Row groups read by different tasks, and batches smaller than a row group."""
    minutes = list(range(20_000))
    minutes[7000], minutes[7001] = minutes[7001], minutes[7000]
    minutes[10_000], minutes[9_999] = minutes[9_999], minutes[10_000]
    write(tmp_path / "a.parquet", minutes, row_group_size=5000)
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = sort_check(spark, str(tmp_path), "ts").first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.out_of_order == 2


def test_sorting_keeps_every_row_and_orders_the_files(spark, tmp_path):
    log = query_log(spark, SF).repartition(5)
    path = str(tmp_path / "sorted")
    files.write_sorted(log, path, n=6)
    back = files.read_log(spark, path)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, log.collect()))
    assert sort_check(spark, path).first().out_of_order == 0
    assert len(back.inputFiles()) == 6


def test_a_burst_with_one_timestamp_is_spread(spark):
    """A third of the rows share one timestamp, another third are copies of one row."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 2, F.col("id")).otherwise(0).alias("minute"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("query_id"),
    ).select((F.lit(T0) + F.make_dt_interval(mins=F.col("minute").cast("int"))).alias("ts"), "query_id")
    sizes = (
        ordering.sort_log(df, "ts", 8)
        .groupBy(F.spark_partition_id().alias("p")).count().collect()
    )
    assert sum(r["count"] for r in sizes) == 6000
    assert max(r["count"] for r in sizes) < 6000 / 4


def test_chunks_cover_all_rows_evenly(spark):
    sizes = spark.range(0, 1000, 1, 4).groupBy(windows.chunk_id(10)).count().collect()
    assert len(sizes) == 10 and all(r["count"] == 100 for r in sizes)


def test_csv_has_a_header(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.export_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string").coalesce(1), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["n", "t"]
    assert sorted(map(tuple, back.collect())) == [("1", "a,b"), ("2", None)]


def test_saved_table(spark):
    files.save_table(spark.range(5), "saved_numbers")
    assert spark.table("saved_numbers").count() == 5
    with pytest.raises(Exception, match="already exists"):
        files.save_table(spark.range(5), "saved_numbers")
    spark.sql("DROP TABLE saved_numbers")


def test_schema_listing_and_union_of_files(spark):
    path = f"{SF}/events.parquet"
    df = files.read_log(spark, path, path)
    listed = [(r.name, r.type) for r in files.describe_schema(df).orderBy("position").collect()]
    assert listed[0] == ("event_id", "bigint") and len(listed) == 6
    assert files.count_rows(df) == 2000 and files.preview(df).count() == 20


def test_column_types_for_a_database(spark):
    df = spark.sql(
        "SELECT 1L AS big, 1 AS small, 1.5D AS d, 'x' AS t, true AS b, current_timestamp() AS ts,"
        " CAST(1 AS FLOAT) AS f, INTERVAL 1 DAY AS i, array(1) AS other, CAST(1 AS DECIMAL(9,2)) AS m")
    text = jdbc.jdbc_column_types(df.schema)
    assert text == (
        '`big` BIGINT, `small` INT, `d` DOUBLE, `t` STRING, `b` BOOLEAN, `ts` TIMESTAMP,'
        ' `f` FLOAT, `i` STRING, `other` STRING, `m` DECIMAL(9,2)')
    # Spark's writer hands the text to its own parser.
    parsed = T.StructType.fromDDL(text)
    assert parsed.names == df.columns
    assert T.StructType.fromDDL(jdbc.jdbc_column_types(spark.sql("SELECT 1 AS `a``b`").schema)).names == ["a`b"]
    assert jdbc.create_table_sql(df.select("t").schema, "logs") == (
        'CREATE TABLE IF NOT EXISTS logs ("t" TEXT)')


def test_database_options_leave_out_what_is_unset():
    got = jdbc.jdbc_options("jdbc:x", user="u", dbtable="t", batchsize=5, password=None)
    assert got == {"url": "jdbc:x", "user": "u", "dbtable": "t", "batchsize": "5"}


class FakeSession:
    """Just the settings a session is asked for."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(FakeSession("yarn", "hdfs:///work/")) == "hdfs:///work"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local)
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
