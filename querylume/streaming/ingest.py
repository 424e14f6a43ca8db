"""The ingest: messages in, checked and stored per micro-batch."""

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from querylume.functions.casts import to_ts_lenient
from querylume.jobs import run_together
from querylume.operators.cleaning import clean_log, conform
from querylume.operators.filters import TYPE_KEY
from querylume.operators.projections import with_day
from querylume.operators.quality import anomalies
from querylume.schema import STREAM_COLUMNS
from querylume.sources.files import balanced
from querylume.sources.messages import message_stream, parsed, rejected_of, rows_of
from querylume.streaming.commits import marked
from querylume.streaming.ids import blocks_for, day_blocks, filters, suspects
from querylume.streaming.live import add_live
from querylume.streaming.refresh import refresh_views
from querylume.streaming.retention import EXPIRING, expired_in_store, parts_of_days
from querylume.streaming.sinks import (
    add_days, add_sketch, append_anomalies, append_log, append_rejected, batch_part,
    part_name, write_part,
)
from querylume.streaming.store import LogStore

UNREADABLE = "not a JSON array of rows"
UNDATED = "no valid arrival_timestamp"


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """One row per ``query_id``: the smallest by timestamp and the other columns, so
    a replay keeps the same one. Rows without an id are all kept."""
    rest = [c for c in rows.columns if c not in ("arrival_timestamp", "query_id")]
    first = F.min(F.struct("arrival_timestamp", "query_id", *rest)).alias("r")
    known = rows.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(first)
    unknown = rows.filter(F.col("query_id").isNull())
    return known.select("r.*").unionByName(unknown)


def _unseen(rows, batch_id, store, days, kept, came=None):
    """Without the rows whose id an earlier batch has stored for the same day. Batches
    from this one on do not count, so a replay decides as the first run did.

    The filters of stored ids (see ``ids``) say which ids may be there and in which parts;
    only these parts' ids are read, and only when there are any. A day that retention has
    removed, or that is not stored yet, has no filter, so its rows stay. ``kept`` persists
    a frame until the batch is done. ``came`` (day, query_id) names the ids to look for and
    maybe others, where that is cheaper than to derive ``rows`` once more.
    """
    spark = rows.sparkSession
    live = store.live(spark)
    held = [p for p in live.of("ids", days) if p.last < batch_id]
    if not held:
        return rows
    heads = spark.createDataFrame(
        [(p.date, p.name, p.blocks) for p in held], "day date, part string, blocks long")
    blocks = store.read_parts(spark, "ids", held, with_part=True)
    maybe = kept(suspects(rows if came is None else came, heads, blocks))
    met = {(r["day"], r["part"]) for r in maybe.select("day", "part").distinct().collect()}
    parts = [p for p in live.of("main", days) if (p.date, p.name) in met]
    if not parts:
        return rows
    asked = maybe.select(F.col("query_id").alias("_id"), F.col("day").alias("_day")).distinct()
    same = (F.col("query_id") == F.col("_id")) & (F.col("day") == F.col("_day"))
    stored = store.read_parts(spark, "main", parts).select("query_id", "day")
    return rows.join(asked.join(stored, same, "left_semi"), same, "left_anti")


def _ids_per_day(rows):
    """The days of some rows and their ids; bounded by the calendar."""
    return {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count("query_id").alias("n")).collect()}


def add_filters(rows, batch_id, store, name):
    """Filters of the ids the batch stores; returns the parts to commit."""
    known = _ids_per_day(rows)
    made = filters(rows, day_blocks(rows.sparkSession, known))
    parts = write_part(made, store, batch_part("ids", batch_id, name))
    return [replace(p, blocks=blocks_for(known[p.date])) for p in parts]


def ingest_batch(messages: DataFrame, batch_id: int, store: LogStore, *, dedupe=False,
                 archive=True, live=False, sketch_capacity=None, refresh="day_change",
                 retention_days=None) -> None:
    """Check and store one micro-batch.

    The decoded messages are kept for the duration of the batch. The main table is written
    first, and what else is made of the typed rows reads them from there: a written part is
    cut into even files, while a frame that is persisted keeps the partitions of its shuffle,
    one for a day however long. The other writes run side by side, each into folders of this
    try alone, and one commit switches them all in; what an earlier try of the batch committed
    goes in the same commit.

    ``dedupe`` stores one row per query id and day, also over batches. ``live`` keeps the
    live numbers. ``refresh`` is ``"day_change"`` (when a day shows up for the first
    time), ``"batch"`` or ``"never"``. ``retention_days`` removes older days from the main
    table and the summaries, never from the archive (default: keep all); rows of such days
    that come later go to the archive only.
    """
    spark = messages.sparkSession
    name = part_name("b")
    made, frames = [], []

    def kept(df):
        frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return frames[-1]

    try:
        decoded = kept(parsed(messages))
        texts = rows_of(decoded)
        unreadable = rejected_of(decoded).withColumn("reason", F.lit(UNREADABLE))
        undated = _undated(texts).withColumn("reason", F.lit(UNDATED))
        rows = clean_log(conform(texts))
        if dedupe:
            came = with_day(rows).select("day", "query_id")
            days = {r["day"] for r in came.select("day").distinct().collect()}
            rows = _unseen(with_day(drop_duplicates(rows)), batch_id, store, days, kept, came)
        made.extend(append_log(balanced(with_day(rows)), batch_id, store, name))
        typed = store.read_written(spark, "main", name, made).drop(TYPE_KEY, "batch_id")
        writes = [
            lambda: made.extend(append_anomalies(anomalies(texts), batch_id, store, name)),
            lambda: made.extend(append_rejected(unreadable.unionByName(undated), batch_id, store, name)),
            lambda: add_days(typed, batch_id, store),
        ]
        if dedupe:
            writes.append(lambda: made.extend(add_filters(typed, batch_id, store, name)))
        if archive:
            writes.append(lambda: made.extend(append_log(typed, batch_id, store, name, "archive")))
        if live:
            writes.append(lambda: made.extend(add_live(typed, batch_id, store, name)))
        if sketch_capacity:
            writes.append(lambda: add_sketch(typed, batch_id, store, sketch_capacity))
        run_together(spark, *writes)
        gone = expired_in_store(spark, store, retention_days, batch_id + 1) if retention_days else []
        store.commit(spark, lambda now: _switched(now, made, batch_id, gone))
        if refresh == "batch" or (refresh == "day_change" and _new_day(spark, store, batch_id)):
            refresh_views(spark, store)
    finally:
        for df in frames:
            df.unpersist()


def _switched(now, made, batch_id, gone):
    """The commit of a batch: its parts instead of those of an earlier try, and without the
    expired days. Rows of that try that summaries have counted are still to be taken off."""
    expired = parts_of_days(now, gone)
    held = {p.folder for p in expired}
    before = [p for p in now.parts.values() if p.level == 0 and p.first == p.last == batch_id
              and p.folder not in held and p.state != "gone"]
    counted = marked([p for p in before if p.table == "main" and p.state == "done"], "gone")
    add = [p for p in made if not (p.table in EXPIRING and p.date in set(gone))]
    return add + counted, expired + before, batch_id


def _undated(texts):
    """Rows without a valid timestamp, as JSON objects."""
    bad = to_ts_lenient(F.col("arrival_timestamp")).isNull()
    as_json = F.to_json(F.struct(*STREAM_COLUMNS), {"ignoreNullFields": "false"})
    return texts.filter(bad).select(as_json.alias("value"))


def _new_day(spark, store, batch_id):
    """Whether the batch brought a day that no batch before it had."""
    before = store.days(spark, before=batch_id).select(F.col("day").alias("_day"))
    now = store.days(spark, before=batch_id + 1)
    return not now.join(before, F.col("day") == F.col("_day"), "left_anti").isEmpty()


def run_ingest(spark, source: dict, store: LogStore, checkpoint: str, *, max_messages=None,
               max_files=None, trigger=None, **options):
    """Start the ingest of a message source; returns the streaming query.

    Resumes from ``checkpoint`` (a shared folder). Without a ``trigger`` it takes
    what is there and stops; pass ``{"processingTime": "5 seconds"}`` to keep going.
    """
    messages = message_stream(spark, source, max_messages, max_files)
    return (
        messages.writeStream
        .foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, store, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
