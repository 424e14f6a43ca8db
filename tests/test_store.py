"""The commits of a store, and what may run side by side because of them."""

import datetime
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import CLEAN, first_plan
from querylume.plans import distinct, views
from querylume.session import scratch_path
from querylume.streaming import commits, ids, ingest, live, merging, refresh
from querylume.streaming.commits import Part, commit, read_live
from querylume.streaming.ingest import ingest_batch, run_ingest
from querylume.streaming.merging import compact, planned, vacuum
from querylume.streaming.refresh import days_to_refresh, refresh_views
from querylume.streaming.retention import expire
from querylume.streaming.store import LogStore

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
    def run(batch_id, *texts, **options):
        df = spark.createDataFrame([(t,) for t in texts], "value string")
        ingest_batch(df, batch_id, store, **{"refresh": "never", "archive": False, **options})
    return run


def rows(spark, store, table="main"):
    return Counter((r.day.day, r.query_id) for r in store.read(spark, table).collect())


def same_summaries(spark, store):
    main = store.read(spark, "main")
    for name, (counts, shares) in views.SUMMARIES.items():
        stored = sorted(map(str, store.summary(spark, name).collect()))
        assert stored == sorted(map(str, shares(counts(main)).collect())), name


# -- commits ----------------------------------------------------------------------------


def part(name, day="2024-01-01", **more):
    return Part("main", name, day, **more)


def test_commits_follow_each_other_and_are_read_from_the_last_whole_one(spark, store):
    folder = store.path("_commits")
    assert read_live(spark, folder) == commits.Live(parts={})
    for k in range(40):
        old = [part(f"p{k - 3}")] if k >= 3 else []
        commit(spark, folder, lambda live, k=k, old=old: ([part(f"p{k}", first=k, last=k)], old, k))
    now = read_live(spark, folder)
    assert (now.version, now.batch) == (39, 39)
    assert {p.name for p in now.of("main")} == {"p37", "p38", "p39"}
    assert now.of("main", [DAY[1]]) == [] and len(now.of("main", [DAY[0]])) == 3
    assert commit(spark, folder, lambda live: None) == now


def test_writers_at_one_time_all_get_in(spark, store):
    folder, tries = store.path("_commits"), Counter()

    def write(k):
        def change(live):
            tries[k] += 1
            return [part(f"p{k}")], [], None
        commit(spark, folder, change)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    now = read_live(spark, folder)
    assert {p.name for p in now.of("main")} == {f"p{k}" for k in range(8)}
    assert now.version == 7 and sum(tries.values()) >= 8


def test_a_commit_that_another_was_faster_with_is_made_again(spark, store):
    folder, seen = store.path("_commits"), []

    def change(live):
        seen.append(live.version)
        if len(seen) == 1:
            commit(spark, folder, lambda now: ([part("other")], [], None))
        return [part("mine")], [], None

    commit(spark, folder, change)
    assert seen == [-1, 0]
    assert {p.name for p in read_live(spark, folder).of("main")} == {"other", "mine"}


def test_a_batch_that_dies_before_its_commit_is_not_seen(spark, store, feed, monkeypatch):
    feed(0, message(on(1, 1, execution_duration_ms=-1)), "not json", live=True, dedupe=True)
    before = rows(spark, store)
    with monkeypatch.context() as broken:
        def dies(*args):
            raise RuntimeError("lost")
        broken.setattr(LogStore, "commit", dies)
        with pytest.raises(RuntimeError):
            feed(1, message(on(1, 2, execution_duration_ms=-1), on(2, 3)), "nor this", live=True, dedupe=True)
    assert rows(spark, store) == before
    assert store.read(spark, "anomalies").count() == store.read(spark, "rejected").count() == 1
    assert [r.rows for r in store.days(spark).collect()] == [1]
    assert live.headline_now(spark, store).first().total_queries == 1
    feed(1, message(on(1, 2), on(2, 3)), live=True, dedupe=True)
    assert rows(spark, store) == {(1, 1): 1, (1, 2): 1, (2, 3): 1}
    assert live.headline_now(spark, store).first().total_queries == 3


# -- merging ----------------------------------------------------------------------------


def test_levels_fill_one_after_the_other():
    parts = []
    for k in range(100):
        parts.append(part(f"p{k}", first=k, last=k))
        for m in planned(parts, through=k, fan=4):
            parts = [p for p in parts if p not in m.parts] + [m.into(part(f"m{k}"))]
        counts = Counter(p.level for p in parts)
        assert max(counts.values()) < 4 and planned(parts, through=k, fan=4) == []
    assert sorted((p.first, p.last) for p in parts) == [(0, 63), (64, 79), (80, 95), (96, 99)]
    # Batches that may be replayed, replaced rows and rows of another state stay apart.
    some = [part(f"p{k}", first=k, last=k, state=["new", "done", "gone"][k % 3]) for k in range(9)]
    assert planned(some, through=4, fan=2)[0].parts == [some[1], some[4]]


def test_merged_parts_hold_the_same_rows(spark, store, feed):
    options = {"live": True, "archive": True, "dedupe": True}
    for i in range(5):
        feed(i, message(*[on(d, 10 * i + d, execution_duration_ms=-1) for d in (1, 2, 3)],
                        {"arrival_timestamp": "2024-01-01T11:00:00", "query_id": None}), "no json", **options)
    tables = ("main", "archive", "anomalies", "rejected")
    want = {t: sorted(map(str, store.read(spark, t).collect())) for t in tables}
    rates = sorted(map(str, live.hit_rate_now(spark, store).collect()))
    assert compact(spark, store, 3, days=[DAY[0], DAY[1]], fan=2) > 0
    parts = Counter((p.table, p.day) for p in store.live(spark).parts.values())
    assert parts["main", "2024-01-01"] == parts["ids", "2024-01-01"] == 2 and parts["main", "2024-01-03"] == 5
    compact(spark, store, 3, fan=2)
    assert {t: sorted(map(str, store.read(spark, t).collect())) for t in tables} == want
    assert sorted(map(str, live.hit_rate_now(spark, store).collect())) == rates
    assert all(p.last <= 3 or p.level == 0 for p in store.live(spark).parts.values())
    version = store.live(spark).version
    assert compact(spark, store, 3, fan=2) == 0 and store.live(spark).version == version
    # The last batch is replayed, with other rows; the merged filters still know the ids.
    feed(4, message(on(1, 41), on(2, 12), on(3, 23), on(3, 99)), **options)
    assert rows(spark, store) == Counter(
        [(d, 10 * i + d) for i in range(4) for d in (1, 2, 3)] + [(1, None)] * 4 + [(1, 41), (3, 99)])


def test_a_merge_runs_beside_the_ingest_and_readers(spark, store, feed, monkeypatch):
    """Between any two steps of a merge others write; nothing is lost or there twice."""
    for i in range(4):
        feed(i, message(*[on(d, 10 * i + d) for d in (1, 2)]))
    reader = store.read(spark, "main")
    write, steps = merging.write_part, []

    def meanwhile(df, st, new):
        steps.append(new.table)
        batch = 3 + len(steps)
        feed(batch, message(on(1, 100 + batch), on(2, 200 + batch)))
        refresh_views(spark, store, days=[DAY[1]])
        made = write(df, st, new)
        feed(batch, message(on(1, 100 + batch), on(2, 200 + batch)))  # replayed
        return made

    monkeypatch.setattr(merging, "write_part", meanwhile)
    # Day 2 changes state while it is merged, so its merge is dropped; that of day 1 holds.
    assert compact(spark, store, 3, tables=["main"], fan=2) == 4
    monkeypatch.undo()
    want = Counter([(d, 10 * i + d) for i in range(4) for d in (1, 2)] + [(1, 104), (2, 204)])
    assert steps == ["main"] and rows(spark, store) == want
    levels = Counter((p.day, p.level) for p in store.live(spark).of("main"))
    assert levels["2024-01-01", 1] == 1 and levels["2024-01-02", 0] == 5
    assert reader.count() == 8  # what a reader began with is still there
    compact(spark, store, 4, fan=2)
    assert rows(spark, store) == want
    refresh_views(spark, store)
    same_summaries(spark, store)


def test_a_merge_that_dies_leaves_the_store_as_it_was(spark, store, feed, monkeypatch):
    for i in range(4):
        feed(i, message(on(1, i), on(2, 10 + i)), dedupe=True)
    before, version = rows(spark, store), store.live(spark).version

    def dies(*args):
        raise RuntimeError("lost")

    for place in ((merging, "write_part"), (merging, "filters"), (LogStore, "commit")):
        with monkeypatch.context() as broken:
            broken.setattr(*place, dies)
            with pytest.raises(RuntimeError):
                compact(spark, store, 3, fan=2)
        assert rows(spark, store) == before and store.live(spark).version == version
    assert vacuum(spark, store) == []  # too young to be told from a writer's folders
    gone = vacuum(spark, store, older_than=-60)
    assert gone and rows(spark, store) == before
    compact(spark, store, 3, fan=2)
    assert len(vacuum(spark, store, older_than=-60)) >= 8
    assert rows(spark, store) == before
    assert vacuum(spark, store, older_than=-60) == []


# -- refresh ----------------------------------------------------------------------------


def test_a_refresh_reads_only_what_came_since(spark, store, feed):
    feed(0, message(*[on(d, d) for d in (1, 2, 3)]))
    refresh_views(spark, store)
    feed(1, message(on(1, 4), on(1, 5, user_id=8)))
    live_now = store.live(spark)
    pending = refresh._pending(live_now)
    read = refresh.changes(spark, store, "hit_rate", pending).inputFiles()
    assert [p.date for p in pending] == [DAY[0]]
    assert read and all(f"part={pending[0].name}/" in f for f in read)
    old = {p.folder for p in live_now.of("summaries/hit_rate") if p.date != DAY[0]}
    assert refresh_views(spark, store) == [DAY[0]]
    assert old <= {p.folder for p in store.live(spark).of("summaries/hit_rate")}
    same_summaries(spark, store)
    version = store.live(spark).version
    assert refresh_views(spark, store) == [] and store.live(spark).version == version


def test_a_replay_after_a_refresh_takes_off_what_it_had_added(spark, store, feed):
    feed(0, message(on(1, 1), on(2, 2, was_cached=1)))
    feed(1, message(on(1, 3, user_id=7), on(3, 4, compile_duration_ms=2.0)))
    refresh_views(spark, store)
    for again in (message(on(1, 3, user_id=7), on(3, 4, compile_duration_ms=2.0)),
                  message(on(1, 5, user_id=9), on(2, 6)), message(on(1, 3, user_id=7))):
        feed(1, again)
        feed(1, again)
        refresh_views(spark, store)
        same_summaries(spark, store)
    assert {p.state for p in store.live(spark).of("main", gone=True)} == {"done"}


def test_a_refresh_begins_again_when_the_ingest_was_faster(spark, store, feed, monkeypatch):
    feed(0, message(on(1, 1), on(9, 2)))
    write, calls = refresh.write_part, []

    def meanwhile(df, st, new):
        calls.append(new.name)
        if len(calls) == 1:
            expire(spark, store, 4)
            feed(0, message(on(8, 1), on(9, 2)))
        return write(df, st, new)

    monkeypatch.setattr(refresh, "write_part", meanwhile)
    assert refresh_views(spark, store) == [DAY[7], DAY[8]]
    assert len(set(calls)) == 2
    same_summaries(spark, store)


# -- de-duplication, retention and refresh together -------------------------------------


def test_late_rows_of_a_removed_day_end_nothing(spark, store, feed):
    options = {"dedupe": True, "retention_days": 4, "refresh": "day_change", "archive": True}
    feed(0, message(*[on(d, d) for d in (1, 2, 6, 7)]), **options)
    assert rows(spark, store) == {(6, 6): 1, (7, 7): 1}
    late = message(on(1, 1), on(1, 1), on(2, 50), on(7, 7), on(7, 8))
    for _ in range(2):
        feed(1, late, **options)
    assert rows(spark, store) == {(6, 6): 1, (7, 7): 1, (7, 8): 1}
    assert days_to_refresh(spark, store) == [DAY[6]]
    assert refresh_views(spark, store) == [DAY[6]]
    same_summaries(spark, store)
    assert store.read_days(spark, "main", [DAY[0], DAY[6]]).count() == 2
    feed(2, message(on(2, 50), on(8, 9)), **options)
    assert rows(spark, store) == {(6, 6): 1, (7, 7): 1, (7, 8): 1, (8, 9): 1}
    assert rows(spark, store, "archive")[2, 50] == 3 - 1


def test_a_stream_with_both_restarts_after_late_rows(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), scratch_path(spark, "checkpoint")
    for late in (message(*[on(d, d) for d in (1, 2, 6, 7)]), message(on(1, 1), on(2, 9), on(1, 3)), message(on(7, 7), on(8, 8))):
        spark.createDataFrame([(late,)], "value string").coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):
            run_ingest(spark, {"format": "parquet", "path": folder}, store, checkpoint, dedupe=True,
                       retention_days=4).awaitTermination()
    assert rows(spark, store) == {(6, 6): 1, (7, 7): 1, (8, 8): 1}


def test_a_refresh_by_call_after_retention(spark, store, feed):
    feed(0, message(*[on(d, d) for d in (1, 2, 6, 7)]), retention_days=4)
    assert refresh_views(spark, store) == [DAY[5], DAY[6]]
    same_summaries(spark, store)


# -- filters of ids ---------------------------------------------------------------------


def test_filters_hold_their_ids_and_few_others(spark):
    n = 50_000
    stored = spark.range(n).select((F.col("id") * 7919).alias("query_id"), F.lit(DAY[0]).alias("day"))
    stored = stored.union(spark.createDataFrame([(None, DAY[1]), (5, DAY[1])], "query_id long, day date"))
    known = {DAY[0]: n, DAY[1]: 1}
    made = ids.filters(stored, ids.day_blocks(spark, known)).withColumn("part", F.lit("p"))
    assert made.count() == ids.blocks_for(n) + 1 and ids.blocks_for(n) == 32
    heads = spark.createDataFrame([(d, "p", ids.blocks_for(k)) for d, k in known.items()], "day date, part string, blocks long")
    assert ids.suspects(stored, heads, made).count() == n + 1
    others = spark.range(n).select((F.col("id") * 7919 + 1).alias("query_id"), F.lit(DAY[0]).alias("day"))
    assert ids.suspects(others, heads, made).count() < n // 200
    assert ids.suspects(others.withColumn("day", F.lit(DAY[2])), heads, made).count() == 0
    assert [ids.blocks_for(k) for k in (1, 2048, 2049, 4096, 4097)] == [1, 1, 2, 2, 4]


def test_stored_ids_are_read_only_for_suspects(spark, store, feed, monkeypatch):
    feed(0, message(*[on(d, 100 * d + k) for d in (1, 2, 3) for k in range(20)]), dedupe=True)
    feed(1, message(*[on(d, 100 * d + 50 + k) for d in (1, 2, 3) for k in range(20)]), dedupe=True)
    read, seen = LogStore.read_parts, []

    def watched(self, spark, table, parts, with_part=False):
        seen.extend((table, p.day, p.first) for p in parts if table == "main")
        return read(self, spark, table, parts, with_part)

    monkeypatch.setattr(LogStore, "read_parts", watched)
    feed(2, message(*[on(d, 100 * d + 80 + k) for d in (1, 2, 3) for k in range(9)]), dedupe=True)
    assert seen == []
    feed(3, message(on(2, 205), on(2, 298), on(1, 299)), dedupe=True)
    assert seen == [("main", "2024-01-02", 0)]
    monkeypatch.undo()
    got = rows(spark, store)
    assert got[2, 205] == got[2, 298] == got[1, 299] == 1 and max(got.values()) == 1
    plan = ingest._unseen(store.read(spark, "main").limit(1), 0, store, {DAY[0]}, lambda df: df)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


# -- distinct queries -------------------------------------------------------------------


def slow_sets(spark, store):
    """Distinct queries by type and by table from the stored rows, range by range."""
    main = store.read(spark, "main").collect()
    out = {}
    for lo in range(1, 5):
        for hi in range(lo, 5):
            some = [r for r in main if lo <= r.day.day <= hi and r.query_id is not None]
            types, tables = {}, {}
            for r in some:
                types.setdefault(r.query_type, set()).add(r.query_id)
                if r.read_table_ids is not None and r.write_table_ids is not None:
                    for t in f"{r.read_table_ids},{r.write_table_ids}".split(","):
                        tables.setdefault(t, set()).add(r.query_id)
            out[lo, hi] = tuple({k: len(v) for k, v in x.items()} for x in (types, tables))
    return out


def same_sets(spark, store):
    sets = store.distinct(spark)
    for (lo, hi), (types, tables) in slow_sets(spark, store).items():
        got = distinct.type_share(sets, DAY[lo - 1], DAY[hi - 1]).collect()
        assert {r.query_type: r["count"] for r in got} == types
        got = distinct.table_share(sets, DAY[lo - 1], DAY[hi - 1]).collect()
        assert {r.table_id: r["count"] for r in got} == tables


def use(day, query_id, reads, writes="9", kind="select"):
    return on(day, query_id, read_table_ids=reads, write_table_ids=writes, query_type=kind)


@pytest.mark.parametrize("few", [0, 2, 1024])
def test_distinct_queries_of_any_range_come_from_stored_sets(spark, store, feed, monkeypatch, few):
    monkeypatch.setattr(distinct, "FEW", few)
    feed(0, message(use(1, 1, "1,1,2"), use(1, 1, "2"), use(2, 1, "1"), use(1, None, "1"), use(3, -40_000, "5", "1"),
                    use(3, 0, "5"), use(1, 2, "3", None), use(4, 9, "7", "7", "copy")))
    refresh_views(spark, store)
    feed(1, message(use(1, 1, "2"), use(1, 70_000, "1"), use(2, 3_000_000_000_000, "1,4", kind="copy"), use(4, 32_768, "1"),
                    use(4, 32_769, "1")))
    refresh_views(spark, store)
    same_sets(spark, store)
    # A replay takes queries away again.
    feed(1, message(use(1, 70_000, "6"), use(2, 5, "1")))
    refresh_views(spark, store)
    same_sets(spark, store)
    for _ in range(2):
        feed(1, message(use(2, 5, "1")))
    refresh_views(spark, store)
    same_sets(spark, store)


def test_full_buckets_are_bitmaps(spark):
    rows = spark.range(5000).select(
        F.lit(DAY[0]).alias("day"), F.lit("select").alias("query_type"), (F.col("id") * 7).alias("query_id"),
        F.when(F.col("id") % 500 == 0, "3").alias("read_table_ids"), F.lit("4").alias("write_table_ids"))
    sets = distinct.query_sets(rows).collect()
    # The ids 1 to 32,768 share a bucket; of table 3 and 4 it holds ten of them at most.
    assert {(r.table_id, r.bits is not None) for r in sets if r.bucket == 1} == {
        (None, True), ("3", False), ("4", False)}
    again = distinct.query_sets(rows.union(rows))
    assert distinct.distinct_counts(again, ["table_id"]).filter("table_id IS NULL").first()["count"] == 5000


def test_sets_without_bitmaps_carry_none_through_a_merge(spark):
    """A bitmap takes 4 kB of every group it is aggregated in, so lists go without."""
    rows = spark.range(3000).select(
        F.lit(DAY[0]).alias("day"), F.lit("select").alias("query_type"), F.col("id").alias("query_id"),
        (F.col("id") % 1500).cast("string").alias("read_table_ids"), F.lit("x").alias("write_table_ids"))
    assert "bitmap_or_agg" not in first_plan(distinct.query_sets(rows))
    two = distinct.query_sets(rows).unionByName(distinct.query_sets(rows.filter("query_id % 2 = 0")))
    both = distinct.merged(two, distinct.KEYS)
    plan = first_plan(both)
    beside = [line for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line]
    assert "bitmap_or_agg" in plan and beside and not any("bitmap_or_agg" in line for line in beside)
    want = {(r.table_id, r.bucket): (sorted(r.few or []), r.bits) for r in distinct.query_sets(rows).collect()}
    assert {(r.table_id, r.bucket): (sorted(r.few or []), r.bits) for r in both.collect()} == want


@pytest.mark.parametrize("dedupe", [False, True])
def test_a_long_day_of_a_batch_is_written_by_several_tasks(spark, store, dedupe):
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {n: spark.conf.get(n, None) for n in names}
    texts = [message(*[on(1, 1000 * m + i, user_id=37 * i) for i in range(300)]) for m in range(8)]
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        sent = spark.createDataFrame([(t,) for t in texts], "value string").repartition(8)
        ingest_batch(sent, 0, store, dedupe=dedupe, live=True, archive=True, refresh="never")
    finally:
        for n, value in before.items():
            spark.conf.set(n, value) if value else spark.conf.unset(n)
    main = store.read(spark, "main")
    assert len(main.inputFiles()) > 1
    assert rows(spark, store) == rows(spark, store, "archive") == Counter(
        (1, 1000 * m + i) for m in range(8) for i in range(300))
    assert [r.rows for r in store.days(spark).collect()] == [2400]
    assert live.headline_now(spark, store).first().total_queries == 2400
