import datetime
import json
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import CLEAN
from querylume.catalog.streams import write_log_messages
from querylume.plans import reports, views
from querylume.session import scratch_path
from querylume.sources import files
from querylume.streaming import live
from querylume.streaming.ingest import ingest_batch, run_ingest
from querylume.streaming.refresh import days_to_refresh, refresh_views
from querylume.streaming.retention import (
    apply_retention, expire, expired_days, retained_main, retained_summary,
)
from querylume.streaming.slots import SLOTS, read_slot, write_slot
from querylume.streaming.sinks import top_tables_seen
from querylume.streaming.store import DAYS_SCHEMA, LogStore, running_total

DAY = [datetime.date(2024, 1, d) for d in range(1, 32)]


def message(*changes):
    return json.dumps([{**CLEAN, **c} for c in changes])


def on(day, query_id, **more):
    return {"arrival_timestamp": f"2024-01-{day:02d}T10:00:00", "query_id": query_id, **more}


@pytest.fixture
def store(spark):
    return LogStore(scratch_path(spark, "store"))


@pytest.fixture
def feed(spark, store):
    """Ingest one micro-batch of messages."""
    def run(batch_id, *texts, **options):
        df = spark.createDataFrame([(t,) for t in texts], "value string")
        ingest_batch(df, batch_id, store, **options)
    return run


def main_rows(spark, store):
    return sorted((r.day.day, r.query_id) for r in store.read(spark, "main").collect())


def test_bad_messages_and_rows_do_not_stop_the_batch(spark, store, feed):
    feed(0, message(on(1, 1), on(1, 2, execution_duration_ms=-1),
                    {"arrival_timestamp": "soon", "query_id": 3},
                    {"arrival_timestamp": None, "query_id": 4}), "not json")
    assert main_rows(spark, store) == [(1, 1), (1, 2)]
    rejected = {r.reason: r.value for r in store.read(spark, "rejected").filter(
        "value NOT LIKE '%\"query_id\":\"4\"%'").collect()}
    assert rejected["not a JSON array of rows"] == "not json"
    assert json.loads(rejected["no valid arrival_timestamp"])["arrival_timestamp"] == "soon"
    found = {r.query_id: (r.day, r.anomaly_description) for r in
             store.read(spark, "anomalies").collect()}
    assert found == {
        2: (DAY[0], "execution_duration_ms is negative (-1.0)"),
        3: (None, "arrival_timestamp expected datetime64[ns], found text"),
    }


def test_a_replayed_batch_replaces_itself(spark, store, feed):
    first = message(on(1, 1), on(2, 2, execution_duration_ms=-1))
    second = message(on(2, 3), on(3, 4))
    for batch in ((0, first), (1, second), (1, second)):
        feed(*batch, sketch_capacity=100)
    feed(1, second, "not json", sketch_capacity=100)
    assert main_rows(spark, store) == [(1, 1), (2, 2), (2, 3), (3, 4)]
    assert store.read(spark, "archive").count() == 4
    assert store.read(spark, "anomalies").count() == 1
    assert store.read(spark, "rejected").count() == 1
    totals = {r.key: r.total_elements_seen for r in running_total(spark, store).collect()}
    assert totals == {"total_rows": 4, "total_tables": 8}
    tops = {r.table_id: r["count"] for r in top_tables_seen(spark, store).collect()}
    assert tops == {"1": 4, "2": 4}


def test_an_empty_batch_changes_nothing(spark, store, feed):
    feed(0, message(on(1, 1)), sketch_capacity=100)
    feed(1, "not json", sketch_capacity=100)
    feed(2, message(on(1, 2)), sketch_capacity=100)
    days = [tuple(r) for r in store.days(spark).collect()]
    assert days == [(DAY[0], 2, 4, 2)]
    assert {r["count"] for r in top_tables_seen(spark, store).collect()} == {2}


def test_state_keeps_only_its_slots(spark, store):
    path = store.path("days")
    for batch in range(SLOTS + 3):
        rows = spark.createDataFrame([(DAY[0], batch, 0, batch)], DAYS_SCHEMA)
        write_slot(rows, path, batch)
    assert read_slot(spark, path, DAYS_SCHEMA).first().rows == SLOTS + 2
    assert read_slot(spark, path, DAYS_SCHEMA, before=SLOTS).first().rows == SLOTS - 1
    assert spark.read.parquet(path).count() == SLOTS


def test_late_rows_land_in_their_day_and_refresh_it(spark, store, feed):
    feed(0, message(on(1, 1), on(2, 2)), refresh="never")
    assert days_to_refresh(spark, store) == DAY[:2]
    assert refresh_views(spark, store) == DAY[:2]
    assert days_to_refresh(spark, store) == []
    feed(1, message(on(5, 3)), refresh="never")
    feed(2, message(on(1, 4)), refresh="never")
    assert main_rows(spark, store) == [(1, 1), (1, 4), (2, 2), (5, 3)]
    assert days_to_refresh(spark, store) == [DAY[0], DAY[4]]
    refresh_views(spark, store)
    main = store.read(spark, "main")
    for name, (counts, shares) in views.SUMMARIES.items():
        stored = sorted(map(str, store.summary(spark, name).collect()))
        assert stored == sorted(map(str, shares(counts(main)).collect())), name


def test_views_refresh_when_a_day_shows_up(spark, store, feed):
    feed(0, message(on(1, 1)))
    assert days_to_refresh(spark, store) == []
    feed(1, message(on(1, 2)))
    assert days_to_refresh(spark, store) == [DAY[0]]
    counts = store.stored_counts(spark, "hit_rate").agg(F.sum("total_count")).first()[0]
    assert counts == 1
    feed(2, message(on(2, 3)))
    assert days_to_refresh(spark, store) == []


def test_refresh_reads_only_the_days_asked_for(spark, store, feed):
    feed(0, message(*[on(d, d) for d in range(1, 6)]), refresh="never")
    rows = store.read_days(spark, "main", [DAY[1], DAY[3]])
    assert sorted(r.query_id for r in rows.collect()) == [2, 4]
    assert len(rows.inputFiles()) == 2


def test_retention_by_filter(spark, store, feed):
    feed(0, message(*[on(d, d) for d in (1, 2, 6, 7)]), refresh="never")
    feed(1, message(on(2, 9)), refresh="never")
    kept = retained_main(spark, store)
    assert sorted(r.query_id for r in kept.collect()) == [6, 7]
    assert store.read(spark, "archive").count() == 5


def test_a_retained_summary_has_its_own_shares(spark, store, feed):
    feed(0, message(on(1, 1), on(7, 2, read_table_ids="5"), on(7, 3, read_table_ids="6")))
    got = retained_summary(spark, store, "table_access")
    assert sorted((r.table_id, r.overall_percentage) for r in got.collect()) == [
        ("5", 50.0), ("6", 50.0)]


def test_reports_as_sql_text(spark, store, feed):
    feed(0, message(on(1, 1, was_cached=1), on(2, 2, execution_duration_ms=-1)))
    store.register(spark)
    rows = spark.sql("SELECT day, hit_rate_per_day FROM hit_rate ORDER BY day").collect()
    assert [tuple(r) for r in rows] == [(DAY[0], 100.0), (DAY[1], 0.0)]
    assert spark.sql("SELECT count(*) FROM query_log").first()[0] == 2
    assert spark.sql("SELECT query_id FROM anomalies").first()[0] == 2


def test_retention_of_a_table(spark, make_log):
    log = make_log(*[on(d, d) for d in range(1, 8)])
    files.save_table(log.withColumn("day", F.to_date("arrival_timestamp")), "kept_log", ["day"])
    try:
        assert expired_days(spark, "kept_log") == DAY[:3]
        assert apply_retention(spark, "kept_log") == DAY[:3]
        assert sorted(r.query_id for r in spark.table("kept_log").collect()) == [4, 5, 6, 7]
        assert apply_retention(spark, "kept_log") == []
    finally:
        spark.sql("DROP TABLE kept_log")


def test_duplicates_keep_the_smallest_row(spark, store, feed):
    feed(0, message(
        on(1, 1, user_id=9), on(1, 1, user_id=3), on(2, 1), on(1, 2),
        on(1, None, user_id=5), on(1, None, user_id=5)), dedupe=True, refresh="never")
    got = Counter((r.query_id, r.user_id, r.day.day) for r in store.read(spark, "main").collect())
    assert got == {(1, 3, 1): 1, (2, 1, 1): 1, (None, 5, 1): 2}


def test_stream_equals_batch_and_resumes(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), scratch_path(spark, "checkpoint")
    source = {"format": "parquet", "path": folder}

    def send(*texts):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode(
            "append").parquet(folder)

    def run():
        run_ingest(spark, source, store, checkpoint, max_files=1).awaitTermination()

    send(message(*[on(1, i) for i in range(5)]))
    send(message(*[on(2, i, was_cached=1) for i in range(5, 9)]), "not json")
    run()
    assert len(main_rows(spark, store)) == 9
    run()
    assert len(main_rows(spark, store)) == 9
    send(message(on(1, 9), on(3, 10)))
    run()
    main = store.read(spark, "main")
    refresh_views(spark, store)
    assert sorted(r.query_id for r in main.collect()) == list(range(11))
    assert sorted(map(str, store.summary(spark, "hit_rate").collect())) == sorted(
        map(str, views.hit_rate_daily(main.drop("day")).collect()))


def test_live_numbers_count_late_rows_and_outlive_a_wrong_clock(spark, store, feed):
    """Days out of order, one far too late, one dated 2099; every batch sent twice."""
    batches = [
        message(on(20, 1, was_cached=1, write_table_ids="1"), on(21, 2, compile_duration_ms=None)),
        message({"arrival_timestamp": "2099-01-01T00:00:00", "query_id": 90}),
        message(on(1, 3, was_cached=1, compile_duration_ms=11.0)),
        message(on(21, 4, query_type="copy", write_table_ids="1,9"), on(21, 2), on(21, 5, write_table_ids="7")),
    ]
    for i, text in enumerate(batches):
        for _ in range(2):
            feed(i, text, live=True, refresh="never")
    everything = store.read(spark, "main").drop("batch_id")
    got, want = live.headline_now(spark, store).first(), reports.headline(everything).first()
    assert got[:3] == want[:3] and got.total_queries == 7
    assert got.latest_query_date == DAY[20]
    assert [r.day.year for r in store.days_in_the_future(spark).collect()] == [2099]
    known = everything.filter("day < '2099-01-01'").drop("day")
    assert sorted(map(tuple, live.type_share_now(spark, store).collect())) == sorted(
        map(tuple, reports.latest_type_share(known).collect()))
    assert sorted(map(tuple, live.table_share_now(spark, store).collect())) == sorted(
        map(tuple, reports.latest_table_share(known).collect()))
    rates = {(r.bucket.year, r.bucket.day): r.hit_rate for r in live.hit_rate_now(spark, store).collect()}
    assert rates == {(2024, 20): 100.0, (2024, 21): 0.0, (2099, 1): 0.0, (2024, 1): 100.0}
    assert live.hit_rate_now(spark, store, [DAY[0]]).count() == 1


def test_an_empty_store_can_be_read(spark, store):
    assert live.headline_now(spark, store).first().total_queries == 0
    assert live.hit_rate_now(spark, store).collect() == []
    assert live.type_share_now(spark, store).collect() == []
    assert top_tables_seen(spark, store).collect() == []
    assert retained_main(spark, store).collect() == [] and expire(spark, store) == []
    for name in views.SUMMARIES:
        assert store.summary(spark, name).collect() == []


def test_duplicates_of_earlier_batches_are_left_out(spark, store, feed):
    first = message(on(1, 1), on(2, 2), on(1, None))
    for batch, text in ((0, first), (1, first), (2, message(on(1, 1), on(3, 3), on(1, 4))), (2, message(
            on(1, 1), on(3, 3), on(1, 4)))):
        feed(batch, text, dedupe=True, refresh="never")
    got = Counter((r.day.day, r.query_id) for r in store.read(spark, "main").collect())
    assert got == {(1, 1): 1, (2, 2): 1, (1, None): 2, (3, 3): 1, (1, 4): 1}
    assert {r.day.day: r.rows for r in store.days(spark).collect()} == {1: 4, 2: 1, 3: 1}


def test_retention_in_the_ingest(spark, store, feed):
    steps = [
        message(on(1, 1), on(2, 2)), message(on(5, 3)), message(on(1, 4), on(5, 5)),
        message({"arrival_timestamp": "2099-01-01T00:00:00", "query_id": 90}), message(on(6, 6)),
    ]
    seen = []
    for i, text in enumerate(steps):
        for _ in range(2):
            feed(i, text, retention_days=4)
        seen.append(main_rows(spark, store))
    assert seen[0] == [(1, 1), (2, 2)]
    assert seen[1] == seen[2][:1] + [(5, 3)] == [(2, 2), (5, 3)]
    assert seen[2] == [(2, 2), (5, 3), (5, 5)]
    assert seen[3] == [(1, 90), (2, 2), (5, 3), (5, 5)]  # 2099-01-01
    assert seen[4] == [(1, 90), (5, 3), (5, 5), (6, 6)]
    assert store.read(spark, "archive").count() == 7
    refresh_views(spark, store, expired=DAY[:2])
    summary = {r.day: r.total_queries for r in store.summary(spark, "hit_rate").collect()}
    assert summary == {DAY[4]: 2, DAY[5]: 1, datetime.date(2099, 1, 1): 1}


def test_no_reader_of_the_log_messages_holds_a_whole_file(spark, tmp_path):
    spark.range(10).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "id AS user_id",
        "'view' AS event_type", "1.5 AS value", """'{"k": 2}' AS props""",
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(600).coalesce(1).selectExpr("repeat(md5(string(id)), 4000) AS text").write.parquet(
        str(tmp_path / "conversations.parquet"))
    write_log_messages(spark, str(tmp_path), str(tmp_path / "messages"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "messages").glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    texts = spark.read.parquet(str(tmp_path / "messages")).filter("value NOT LIKE '[%'")
    assert texts.distinct().count() == 600 and max(groups) <= 200
