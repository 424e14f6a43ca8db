"""The ingest, its tables and the live numbers, each run to the end of its input."""

from pyspark.sql import functions as F

from querylume.catalog.core import ORACLES, log_sql, rounded, table_query
from querylume.catalog.files import TYPED_ROWS
from querylume.catalog.quality import ALL_FOUND, FOUND_ROWS
from querylume.catalog.summaries import ACCESSES, M1, M3, M4, M5_ROWS
from querylume.fixture import query_log
from querylume.operators.filters import of_type
from querylume.operators.quality import latest_anomalies
from querylume.plans import distinct
from querylume.session import scratch_path
from querylume.sources import messages
from querylume.streaming import live
from querylume.streaming.ingest import run_ingest
from querylume.streaming.refresh import refresh_views
from querylume.streaming.retention import retained, retained_main, retained_summary
from querylume.streaming.merging import compact
from querylume.streaming.sinks import top_tables_seen
from querylume.streaming.store import LogStore, running_total

FILES = 4
_RUNS = {}
_LIMITED = {}


def _sent(log):
    """The log as JSON-array messages."""
    return messages.to_batches(log).select("value")


def write_log_messages(spark, sf_dir, folder):
    """The log as JSON-array messages, and every conversation text as a message that
    cannot be read."""
    noise = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("text").alias("value")
    )
    messages.write_messages(_sent(query_log(spark, sf_dir)), {"format": "parquet", "path": folder})
    messages.write_messages(noise, {"format": "parquet", "path": folder})


def run_to_end(spark, base, store, **options):
    source = {"format": "parquet", "path": f"{base}/messages"}
    run_ingest(spark, source, store, f"{base}/checkpoint", **options).awaitTermination()


def _kept(spark, sf_dir, name, make):
    """The store that ``make`` fills, once per session and tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _RUNS:
        base = scratch_path(spark, name)
        store = LogStore(f"{base}/store")
        make(base, store)
        _RUNS[key] = store
    return _RUNS[key]


def ingested(spark, sf_dir):
    """The store after the whole log went through the ingest, in several batches."""
    def make(base, store):
        write_log_messages(spark, sf_dir, f"{base}/messages")
        run_to_end(spark, base, store, max_files=2, sketch_capacity=10_000, refresh="never")
    return _kept(spark, sf_dir, "ingest", make)


def refreshed(spark, sf_dir):
    """A store of its own with its summaries brought up to date."""
    def make(base, store):
        write_log_messages(spark, sf_dir, f"{base}/messages")
        run_to_end(spark, base, store, archive=False, refresh="never")
        refresh_views(spark, store)
    return _kept(spark, sf_dir, "refreshed", make)


def _in_parts(spark, log, base, store, n=FILES, after=None, **options):
    """The log in ``n`` parts, dealt by query id, each sent as the shuffle leaves it and taken
    by one run of the ingest: every part has rows of all days, so all but the first bring
    late ones. ``after`` is called when a part is in."""
    for i in range(n):
        part = log.filter(F.pmod(F.col("query_id"), F.lit(n)) == i)
        messages.write_messages(_sent(part), {"format": "parquet", "path": f"{base}/messages"})
        run_to_end(spark, base, store, **options)
        if after:
            after()


def out_of_order(spark, sf_dir):
    """The store after an ingest of the log out of time order, in several batches, with the
    live numbers."""
    def make(base, store):
        _in_parts(spark, query_log(spark, sf_dir), base, store, live=True, archive=False, refresh="never")
    return _kept(spark, sf_dir, "late", make)


def merged(spark, sf_dir):
    """A store whose parts were merged while the ingest went on."""
    def make(base, store):
        def merge():
            compact(spark, store, store.live(spark).batch, fan=2)
        _in_parts(spark, query_log(spark, sf_dir), base, store, after=merge, live=True, dedupe=True,
                  archive=False, refresh="never")
    return _kept(spark, sf_dir, "merged", make)


DATED_ROWS = TYPED_ROWS.replace(
    "num_scans FROM", "num_scans, CAST(arrival_timestamp AS DATE) AS day FROM"
)


@table_query("x1_ingest_main", log_sql(DATED_ROWS))
def x1(spark, sf_dir):
    return ingested(spark, sf_dir).read(spark, "main").drop("batch_id", "type_key")


@table_query("p17_of_type_stored", log_sql("""
SELECT query_id, query_type FROM query_log WHERE lower(query_type) = 'select'
"""))
def p17_stored(spark, sf_dir):
    """A type asked for in any case, by the column the store keeps for that."""
    return of_type(ingested(spark, sf_dir).read(spark, "main"), "SeLeCt").select("query_id", "query_type")


@table_query("x3_ingest_rejected", "SELECT text AS value FROM conversations")
def x3(spark, sf_dir):
    return ingested(spark, sf_dir).read(spark, "rejected").select("value")


@table_query("x4_ingest_anomalies", log_sql(ALL_FOUND + FOUND_ROWS))
def x4(spark, sf_dir):
    found = ingested(spark, sf_dir).read(spark, "anomalies")
    return found.drop("batch_id", "day")


@table_query("x4_ingest_latest_anomalies", log_sql(ALL_FOUND + FOUND_ROWS + """
 AND arrival_timestamp > TIMESTAMP '2024-01-15 12:00:00'
ORDER BY arrival_timestamp DESC, query_id DESC LIMIT 10
"""))
def x4_latest(spark, sf_dir):
    found = ingested(spark, sf_dir).read(spark, "anomalies")
    return latest_anomalies(found, "2024-01-15 12:00:00").drop("batch_id", "day")


@table_query("x5_rows_per_day_folder", log_sql("""
SELECT CAST(arrival_timestamp AS DATE) AS day, count(*) AS n FROM query_log GROUP BY 1
"""))
def x5(spark, sf_dir):
    main = ingested(spark, sf_dir).read(spark, "main")
    return main.groupBy("day").agg(F.count("*").alias("n"))


RETAINED = """
, days AS (SELECT max(CAST(arrival_timestamp AS DATE)) AS last FROM query_log)
SELECT query_id FROM query_log, days
WHERE CAST(arrival_timestamp AS DATE) > CAST(last - 4 AS DATE)
"""


@table_query("x6_retained_main", log_sql(RETAINED))
def x6(spark, sf_dir):
    return retained_main(spark, ingested(spark, sf_dir)).select("query_id")


@table_query("x6_retained_anomalies", log_sql(ALL_FOUND + """
, days AS (SELECT max(CAST(arrival_timestamp AS DATE)) AS last FROM query_log)
SELECT query_id, anomaly_description FROM found, days
WHERE anomaly_description <> '' AND CAST(arrival_timestamp AS DATE) > CAST(last - 4 AS DATE)
"""))
def x6_anomalies(spark, sf_dir):
    store = ingested(spark, sf_dir)
    found = store.read(spark, "anomalies")
    # The newest day comes from the store's list of days: no data file is opened for it.
    kept = retained(found, newest=store.days(spark))
    return kept.select("query_id", "anomaly_description")


LAST_DAYS = """
, log_days AS (SELECT max(CAST(arrival_timestamp AS DATE)) AS last FROM query_log)
, kept AS (
 SELECT * FROM query_log, log_days
 WHERE CAST(arrival_timestamp AS DATE) > CAST(last - 4 AS DATE)
)
"""


@table_query("x6_retained_summary", log_sql(
    LAST_DAYS + M4.replace("FROM query_log", "FROM kept") + "SELECT * FROM m4"))
def x6_summary(spark, sf_dir):
    return retained_summary(spark, refreshed(spark, sf_dir), "hit_rate")


@table_query("s9_sql_fetch", log_sql(M4 + """
SELECT day, query_type, round(sum(hit_rate_per_day), 6) AS cache_hit_rate FROM m4
WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY day, query_type
"""))
def s9(spark, sf_dir):
    """A report as SQL text over the store's views."""
    refreshed(spark, sf_dir).register(spark)
    return spark.sql("""
        SELECT day, query_type, round(sum(hit_rate_per_day), 6) AS cache_hit_rate FROM hit_rate
        WHERE day BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY day, query_type
    """)


@table_query("s18_archive", log_sql(DATED_ROWS))
def s18(spark, sf_dir):
    return ingested(spark, sf_dir).read(spark, "archive").drop("batch_id")


@table_query("m6_refreshed_table_access", log_sql(M1 + "SELECT * FROM m1"))
def m6_tables(spark, sf_dir):
    return refreshed(spark, sf_dir).summary(spark, "table_access")


@table_query("m6_refreshed_query_types", log_sql(M3 + "SELECT * FROM m3"))
def m6_types(spark, sf_dir):
    return refreshed(spark, sf_dir).summary(spark, "query_types")


@table_query("m6_refreshed_hit_rate", log_sql(M4 + "SELECT * FROM m4"))
def m6_hits(spark, sf_dir):
    return refreshed(spark, sf_dir).summary(spark, "hit_rate")


@table_query("m6_refreshed_compile_by_joins", log_sql(M5_ROWS))
def m6_compile(spark, sf_dir):
    store = refreshed(spark, sf_dir)
    return rounded(store.summary(spark, "compile_by_joins"), "y")


@table_query("m6_refreshed_in_steps", log_sql(M1 + "SELECT * FROM m1"))
def m6_steps(spark, sf_dir):
    """A refresh after every part of the log: each adds what the part brought to its days."""
    def make(base, store):
        _in_parts(spark, query_log(spark, sf_dir), base, store, archive=False, refresh="never",
                  after=lambda: refresh_views(spark, store))
    return _kept(spark, sf_dir, "steps", make).summary(spark, "table_access")


@table_query("m6_refreshed_after_retention", log_sql(
    LAST_DAYS + M4.replace("FROM query_log", "FROM kept") + "SELECT * FROM m4"))
def m6_retained(spark, sf_dir):
    """A refresh by call, after retention has removed days that were never refreshed."""
    def make(base, store):
        write_log_messages(spark, sf_dir, f"{base}/messages")
        run_to_end(spark, base, store, archive=False, retention_days=4, refresh="never")
        refresh_views(spark, store)
    return _kept(spark, sf_dir, "retained", make).summary(spark, "hit_rate")


@table_query("x9_ingest_deduplicated", log_sql("""
SELECT query_id, count(*) AS n FROM query_log GROUP BY 1
"""))
def x9(spark, sf_dir):
    """Every message comes twice, in different batches."""
    def make(base, store):
        for _ in range(2):
            _in_parts(spark, query_log(spark, sf_dir), base, store, 2, dedupe=True, archive=False,
                      refresh="never")
    main = _kept(spark, sf_dir, "deduplicated", make).read(spark, "main")
    return main.groupBy("query_id").agg(F.count("*").alias("n"))


@table_query("x9_late_after_retention", log_sql(RETAINED))
def x9_late(spark, sf_dir):
    """De-duplication and retention together: the log comes a second time, when most of its
    days have been removed, and a third time after that."""
    def make(base, store):
        for _ in range(3):
            sent = _sent(query_log(spark, sf_dir))
            messages.write_messages(sent, {"format": "parquet", "path": f"{base}/messages"})
            run_to_end(spark, base, store, archive=False, dedupe=True, retention_days=4)
    return _kept(spark, sf_dir, "late-retained", make).read(spark, "main").select("query_id")


@table_query("x2_resumed_main", log_sql("SELECT query_id FROM query_log"))
def x2(spark, sf_dir):
    """The ingest stops, more messages come, and it goes on where it was."""
    def make(base, store):
        log = query_log(spark, sf_dir)
        for half in (0, 1):
            part = log.filter(F.col("query_id") % 2 == half)
            messages.write_messages(_sent(part), {"format": "parquet", "path": f"{base}/messages"})
            run_to_end(spark, base, store, archive=False, refresh="never")
    return _kept(spark, sf_dir, "resumed", make).read(spark, "main").select("query_id")


@table_query("x7_late_rows", log_sql("""
SELECT CAST(arrival_timestamp AS DATE) AS day, count(*) AS n FROM query_log GROUP BY 1
"""))
def x7(spark, sf_dir):
    """Late rows land in their own day."""
    main = out_of_order(spark, sf_dir).read(spark, "main")
    return main.groupBy("day").agg(F.count("*").alias("n"))


@table_query("x11_limited_batches", log_sql(f"""
SELECT query_id % {FILES} AS part, count(*) AS n, true AS limited FROM query_log GROUP BY 1
"""))
def x11(spark, sf_dir):
    """Two files a batch: all rows are there, in as many batches as that takes."""
    made = {}

    def make(base, store):
        sent = _sent(query_log(spark, sf_dir))
        messages.write_messages(sent, {"format": "parquet", "path": f"{base}/messages"})
        run_to_end(spark, base, store, max_files=2, archive=False, refresh="never")
        made["files"] = len(spark.read.parquet(f"{base}/messages").inputFiles())
    store = _kept(spark, sf_dir, "limited", make)
    files = _LIMITED.setdefault(store.root, made.get("files"))
    main = store.read(spark, "main")
    batches = main.agg(F.count_distinct("batch_id")).scalar()
    return main.groupBy((F.col("query_id") % FILES).alias("part")).agg(
        F.count("*").alias("n"), (batches == -(-files // 2)).alias("limited"))


@table_query("s11_read_messages", "SELECT text AS value FROM conversations")
def s11(spark, sf_dir):
    """Raw messages, written and read back."""
    sink = {"format": "parquet", "path": scratch_path(spark, "raw")}
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages.write_messages(texts.select(F.col("text").alias("value")), sink)
    return messages.read_messages(spark, sink)


@table_query("x6_applied", log_sql(RETAINED))
def x6_applied(spark, sf_dir):
    """Retention as part of the ingest."""
    def make(base, store):
        write_log_messages(spark, sf_dir, f"{base}/messages")
        run_to_end(spark, base, store, max_files=2, archive=False, retention_days=4)
    return _kept(spark, sf_dir, "expired", make).read(spark, "main").select("query_id")


@table_query("x6_wrong_clock", log_sql(RETAINED + "UNION ALL SELECT -1"))
def x6_wrong_clock(spark, sf_dir):
    """A row dated 2099 stays and makes nothing expire."""
    def make(base, store):
        log = query_log(spark, sf_dir)
        odd = log.orderBy("query_id").limit(1).withColumns({
            "query_id": F.lit(-1).cast("long"),
            "arrival_timestamp": F.lit("2099-01-01 00:00:00").cast(log.schema["arrival_timestamp"].dataType),
        })
        for part in (odd, log):
            messages.write_messages(_sent(part), {"format": "parquet", "path": f"{base}/messages"})
        run_to_end(spark, base, store, archive=False, retention_days=4)
    return _kept(spark, sf_dir, "clock", make).read(spark, "main").select("query_id")


@table_query("x8_refresh_on_day_change", log_sql(M4 + """
SELECT * FROM m4 WHERE day < (SELECT max(day) FROM m4)
"""))
def x8(spark, sf_dir):
    """Summaries refreshed by the ingest itself when a day shows up; fed day by day."""
    def make(base, store):
        log = query_log(spark, sf_dir)
        halves = [F.col("arrival_timestamp") < F.lit("2024-01-16").cast("timestamp_ntz"),
                  F.col("arrival_timestamp") >= F.lit("2024-01-16").cast("timestamp_ntz")]
        for half in halves:
            sent = _sent(log.filter(half))
            messages.write_messages(sent, {"format": "parquet", "path": f"{base}/messages"})
            run_to_end(spark, base, store, archive=False)
    store = _kept(spark, sf_dir, "refreshing", make)
    shown = store.summary(spark, "hit_rate")
    return shown.filter(F.col("day") < shown.agg(F.max("day")).scalar())


@table_query("s14_compacted", log_sql(DATED_ROWS))
def s14(spark, sf_dir):
    """The main table, its parts merged."""
    return merged(spark, sf_dir).read(spark, "main").drop("batch_id", "type_key")


@table_query("s14_merged_anomalies", log_sql(ALL_FOUND + FOUND_ROWS))
def s14_anomalies(spark, sf_dir):
    return merged(spark, sf_dir).read(spark, "anomalies").drop("batch_id", "day")


@table_query("a11_top_tables_seen", log_sql(ACCESSES + """
SELECT table_id, count(*) AS count FROM accesses GROUP BY table_id
"""))
def a11_seen(spark, sf_dir):
    store = ingested(spark, sf_dir)
    return top_tables_seen(spark, store, k=1000)


@table_query("a12_running_total", log_sql(ACCESSES + """
SELECT 'total_rows' AS key, count(*) AS total_elements_seen FROM query_log
UNION ALL SELECT 'total_tables', count(*) FROM accesses
"""))
def a12(spark, sf_dir):
    return running_total(spark, ingested(spark, sf_dir))


# -- live numbers -------------------------------------------------------------------


@table_query("x10_live_headline", log_sql("""
SELECT count(*) AS total_queries,
 CAST(sum(was_cached) AS DOUBLE) / count(*) * 100 AS cache_hit_rate,
 round(avg(compile_duration_ms), 6) AS avg_compile_time,
 max(CAST(arrival_timestamp AS DATE)) AS latest_query_date
FROM query_log
"""))
def x10_headline(spark, sf_dir):
    return rounded(live.headline_now(spark, out_of_order(spark, sf_dir)), "avg_compile_time")


@table_query("x10_live_hit_rate", log_sql("""
SELECT time_bucket(INTERVAL 5 MINUTE, arrival_timestamp) AS bucket,
 CAST(count(*) FILTER (WHERE was_cached = 1) AS DOUBLE) / count(*) * 100 AS hit_rate
FROM query_log GROUP BY 1
"""))
def x10_hit_rate(spark, sf_dir):
    return live.hit_rate_now(spark, out_of_order(spark, sf_dir))


@table_query("x10_merged_hit_rate", ORACLES["x10_live_hit_rate"])
def x10_merged(spark, sf_dir):
    """The same from merged buckets."""
    return live.hit_rate_now(spark, merged(spark, sf_dir))


LIVE_LATEST = """
, latest AS (
 SELECT * FROM query_log WHERE CAST(arrival_timestamp AS DATE) =
  (SELECT max(CAST(arrival_timestamp AS DATE)) FROM query_log)
)
"""


@table_query("x10_live_type_share", log_sql(LIVE_LATEST + """
SELECT query_type, count(DISTINCT query_id) AS count,
 CAST(count(DISTINCT query_id) AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM latest) * 100
  AS overall_percentage
FROM latest GROUP BY query_type
"""))
def x10_types(spark, sf_dir):
    return live.type_share_now(spark, out_of_order(spark, sf_dir))


@table_query("x10_live_table_share", log_sql(LIVE_LATEST + """
, uses AS (
 SELECT query_id, unnest(string_split(read_table_ids || ',' || write_table_ids, ',')) AS table_id
 FROM latest
)
SELECT table_id, count(DISTINCT query_id) AS count,
 CAST(count(DISTINCT query_id) AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM latest) * 100
  AS overall_percentage
FROM uses GROUP BY table_id
"""))
def x10_tables(spark, sf_dir):
    return live.table_share_now(spark, out_of_order(spark, sf_dir))


# -- distinct queries from stored sets ------------------------------------------------


def repeated(spark, sf_dir):
    """A store that took the log and, later, every third query of it again; refreshed after
    each, and the second time out of time order."""
    def make(base, store):
        log = query_log(spark, sf_dir)
        for part in (log, log.filter(F.col("query_id") % 3 == 0)):
            messages.write_messages(_sent(part), {"format": "parquet", "path": f"{base}/messages"})
            run_to_end(spark, base, store, archive=False, refresh="never")
            refresh_views(spark, store)
    return _kept(spark, sf_dir, "repeated", make)


def _distinct_sql(key, source, days):
    return log_sql(f"""
, twice AS (SELECT * FROM query_log UNION ALL SELECT * FROM query_log WHERE query_id % 3 = 0)
, picked AS (SELECT * FROM twice WHERE {days})
, uses AS (
 SELECT query_id, unnest(string_split(read_table_ids || ',' || write_table_ids, ',')) AS table_id
 FROM picked
)
SELECT {key}, count(DISTINCT query_id) AS count,
 CAST(count(DISTINCT query_id) AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM picked) * 100
  AS overall_percentage
FROM {source} GROUP BY {key}
""")


RANGE = "CAST(arrival_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
LATEST_DAY = "CAST(arrival_timestamp AS DATE) = (SELECT max(CAST(arrival_timestamp AS DATE)) FROM query_log)"


@table_query("q8_type_share_of_range", _distinct_sql("query_type", "picked", RANGE))
def q8_range(spark, sf_dir):
    sets = repeated(spark, sf_dir).distinct(spark)
    return distinct.type_share(sets, "2024-01-05", "2024-01-20")


@table_query("q9_table_share_of_range", _distinct_sql("table_id", "uses", RANGE))
def q9_range(spark, sf_dir):
    sets = repeated(spark, sf_dir).distinct(spark)
    return distinct.table_share(sets, "2024-01-05", "2024-01-20")


@table_query("q8_type_share_stored", _distinct_sql("query_type", "picked", LATEST_DAY))
def q8_stored(spark, sf_dir):
    """The latest day's types, from the stored sets."""
    store = repeated(spark, sf_dir)
    day = store.newest_day(spark)
    return distinct.type_share(store.distinct(spark), day, day)


@table_query("q9_table_share_stored", _distinct_sql("table_id", "uses", LATEST_DAY))
def q9_stored(spark, sf_dir):
    store = repeated(spark, sf_dir)
    day = store.newest_day(spark)
    return distinct.table_share(store.distinct(spark), day, day)
