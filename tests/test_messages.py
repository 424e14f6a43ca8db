import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import CLEAN
from querylume.fixture import query_log
from querylume.operators.cleaning import conform
from querylume.operators.projections import drop_raw_only
from querylume.sources import messages

SF = "/root/testdata/sf0.001"


def test_messages_hold_at_most_n_rows_in_time_order(spark):
    log = query_log(spark, SF)
    sent = messages.to_batches(log, 64, slices=3).collect()
    decoded = {(r.slice, r.chunk): json.loads(r.value) for r in sent}
    assert sum(map(len, decoded.values())) == 1000
    assert all(len(rows) <= 64 for rows in decoded.values())
    # Only the last message of a slice may be short.
    last = {s: max(c for t, c in decoded if t == s) for s, _ in decoded}
    assert all(len(rows) == 64 for (s, c), rows in decoded.items() if c != last[s])
    stamps = [row["arrival_timestamp"] for key in sorted(decoded) for row in decoded[key]]
    assert stamps == sorted(stamps)


def test_messages_leave_out_raw_columns_and_keep_nulls(make_log):
    log = make_log({"write_table_ids": None}).withColumn("mbytes_scanned", F.lit(1.0))
    row = json.loads(messages.to_batches(log).first().value)[0]
    assert list(row) == list(CLEAN) and row["write_table_ids"] is None
    assert row["arrival_timestamp"] == "2024-01-01T10:00:00.000000"


@pytest.mark.parametrize("encode", [
    lambda log: messages.to_batches(log, 100), lambda log: messages.to_messages(log, None)])
def test_round_trip(spark, encode):
    log = drop_raw_only(query_log(spark, SF))
    back = conform(messages.rows_of(messages.parsed(encode(log).select("value"))))
    sent = conform(log).withColumn("arrival_timestamp", F.col("arrival_timestamp").cast("timestamp"))
    assert sorted(map(str, back.collect())) == sorted(map(str, sent.collect()))


def test_first_rows_only(spark):
    assert messages.to_messages(query_log(spark, SF), 20).count() == 20
    assert messages.to_messages(query_log(spark, SF)).count() == query_log(spark, SF).count()


def test_unreadable_messages_are_set_apart(spark):
    good = json.dumps([{**CLEAN, "num_joins": 2.0}, {**CLEAN, "num_joins": float("nan")}])
    texts = [good, "nope", "", None, "[1, 2]", '[{"user_id": 1}, 3]', good[:-1], "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows, rejected = messages.split_rejected(df)
    assert [r.num_joins for r in conform(rows).orderBy("num_joins").collect()] == [None, 2]
    assert [r.value for r in rejected.collect()] == texts[1:7]


def test_input_limits_and_start(spark, tmp_path):
    source = {"format": "parquet", "path": str(tmp_path)}
    assert messages.message_stream(spark, source, max_files=3).columns == ["value"]
    assert messages.read_batches(spark, source).columns == list(CLEAN)


def test_message_files_have_short_row_groups(spark, tmp_path):
    """A Parquet reader holds up to 4096 rows of a row group, which is a GB of long messages."""
    long = spark.range(600).repartition(1).select(F.expr("repeat(md5(string(id)), 4000)").alias("value"))
    sink = {"format": "parquet", "path": str(tmp_path / "messages")}
    messages.write_messages(long, sink)
    groups = []
    for name in (tmp_path / "messages").glob("*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) == 600 and max(groups) <= 200
    read = messages.read_messages(spark, sink)
    assert read.select(F.md5("value")).distinct().count() == 600
    assert read.agg(F.sum(F.length("value"))).first()[0] == 600 * 4000 * 32
