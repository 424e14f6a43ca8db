"""Basic aggregates, windows, sorts and functions."""

from pyspark.sql import Window, functions as F

from querylume.catalog.core import (
    ONLY_LOG_ROWS, log_sql, only_log_rows, query, rounded, table_query, written_table,
)
from querylume.catalog.summaries import ACCESSES
from querylume.fixture import query_log
from querylume.functions import casts, lists, numbers, times
from querylume.operators import aggregation, ordering, windows
from querylume.operators.projections import distinct_on, with_day
from querylume.streaming.sinks import top_tables_approx


@query("a1_count", "SELECT query_type, count(*) AS n FROM query_log GROUP BY query_type")
def a1(log):
    return log.groupBy("query_type").agg(numbers.count_rows().alias("n"))


@query("a2_count_if", """
SELECT query_type, count(*) FILTER (WHERE was_cached = 1) AS n FROM query_log GROUP BY query_type
""")
def a2(log):
    return log.groupBy("query_type").agg(numbers.count_if(F.col("was_cached") == 1).alias("n"))


@query("a3_sum", """
SELECT query_type, CAST(sum(num_joins) AS BIGINT) AS joins, round(sum(mbytes_scanned), 6) AS scanned
FROM query_log GROUP BY query_type
""")
def a3(log):
    sums = log.groupBy("query_type").agg(
        numbers.sum_of(log, "num_joins").alias("joins"),
        numbers.sum_of(log, "mbytes_scanned").alias("scanned"),
    )
    return rounded(sums, "scanned")


@query("a4_avg", """
SELECT query_type, round(avg(compile_duration_ms), 6) AS mean FROM query_log GROUP BY query_type
""")
def a4(log):
    means = log.groupBy("query_type").agg(numbers.mean_of(log, "compile_duration_ms").alias("mean"))
    return rounded(means, "mean")


@query("a5_min_max", """
SELECT min(arrival_timestamp) AS first, max(arrival_timestamp) AS last FROM query_log
""")
def a5(log):
    ts = "arrival_timestamp"
    return log.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


@query("a6_count_distinct", """
SELECT query_type, count(DISTINCT user_id) AS users FROM query_log GROUP BY query_type
""")
def a6(log):
    return log.groupBy("query_type").agg(F.count_distinct("user_id").alias("users"))


@query("a7_distinct", "SELECT DISTINCT query_type, user_id FROM query_log")
def a7(log):
    return distinct_on(log, ["query_type", "user_id"])


@query("a8_value_counts", """
SELECT num_joins, count(*) AS count FROM query_log WHERE num_joins IS NOT NULL GROUP BY num_joins
""")
def a8(log):
    return aggregation.value_counts(log, "num_joins")


@query("a9_mode", """
, counted AS (
 SELECT query_type, num_scans, count(*) AS n FROM query_log GROUP BY query_type, num_scans
)
SELECT query_type, num_scans FROM counted
QUALIFY row_number() OVER (PARTITION BY query_type ORDER BY n DESC, num_scans) = 1
""")
def a9(log):
    return aggregation.mode_smallest(log, "query_type", "num_scans")


@query("a10_safe_ratio", """
SELECT query_id, CAST(num_joins AS DOUBLE) / nullif(num_scans, 0) AS ratio FROM query_log
""")
def a10(log):
    return log.select(
        "query_id", numbers.safe_ratio(F.col("num_joins"), F.col("num_scans")).alias("ratio")
    )


@query("a11_top_tables_approx", ACCESSES + """
SELECT table_id, count(*) AS count FROM accesses GROUP BY table_id
""")
def a11(log):
    """Asked for more items than there are tables, so the whole summary is compared."""
    return top_tables_approx(log, k=1000, capacity=10_000)


# -- windows and sorts ------------------------------------------------------------

PER_DAY = """
, daily AS (
 SELECT CAST(arrival_timestamp AS DATE) AS day, count(*) AS n FROM query_log GROUP BY 1
)
"""


def _per_day(log):
    return with_day(log).groupBy("day").agg(F.count("*").alias("n"))


@query("w1_chunk_id", """
SELECT CAST(i AS INTEGER) AS chunk, true AS fair FROM range(10) t(i)
""")
def w1(log):
    """Every chunk by its number, and whether it has a tenth of the rows, but for one row of
    each partition."""
    parts = log.select(F.spark_partition_id().alias("part")).agg(F.count_distinct("part")).scalar()
    total = log.agg(F.count("*")).scalar()
    sizes = log.groupBy(windows.chunk_id(10).alias("chunk")).agg(F.count("*").alias("n"))
    return sizes.select("chunk", (F.abs(F.col("n") * 10 - total) <= 10 * parts).alias("fair"))


@query("w2_lag", PER_DAY + "SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM daily")
def w2(log):
    return _per_day(log).withColumn("before", windows.lag_over("n", ["day"]))


@query("w3_rolling_mean", PER_DAY + """
SELECT day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS n
FROM daily
""")
def w3(log):
    return rounded(windows.rolling_mean(_per_day(log), "day", ["n"], 7), "n")


@query("w4_share_of_total", PER_DAY + """
SELECT day, n, CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM daily) * 100 AS share
FROM daily
""")
def w4(log):
    return aggregation.share_of_total(_per_day(log), "n")


@query("w4_share_within_type", """
, counted AS (SELECT query_type, user_id, count(*) AS n FROM query_log GROUP BY ALL)
SELECT query_type, user_id, n,
 CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY query_type) AS DOUBLE) * 100 AS share
FROM counted
""")
def w4_within(log):
    counted = log.groupBy("query_type", "user_id").agg(F.count("*").alias("n"))
    return aggregation.share_of_total(counted, "n", by=["query_type"])


@query("o1_order", PER_DAY + """
SELECT day, n, row_number() OVER (ORDER BY n DESC, day) AS position FROM daily
""")
def o1(log):
    """Every row with its place in the output: in its partition, after those before."""
    ordered = ordering.order(_per_day(log), F.desc("n"), "day").select(
        "day", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    ordered = written_table(ordered)
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ordered.withColumn("place", place).join(parts, "part").select(
        "day", "n", (F.col("before") + F.col("place")).alias("position"))


@query("o2_top_k", """
SELECT user_id, count(*) AS n FROM query_log GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5
""")
def o2(log):
    counted = log.groupBy("user_id").agg(F.count("*").alias("n"))
    return ordering.top_k(counted, "n", 5, tie_keys=["user_id"])


@query("o3_sort_log", "SELECT * FROM query_log ORDER BY arrival_timestamp")
def o3(log):
    return ordering.sort_log(log)


@query("o4_limit", ONLY_LOG_ROWS.format(n=500))
def o4(log):
    return only_log_rows(ordering.limit(log, 500), log)


@table_query("s17_sample_n", log_sql("""
SELECT * FROM query_log ORDER BY md5(concat(query_id, ':', 42)), query_id LIMIT 10000
"""))
def s17(spark, sf_dir):
    return ordering.sample_n(query_log(spark, sf_dir), 10_000, 42)


@table_query("s17_sample_size", log_sql("""
SELECT least(count(*), 10000) AS n, least(count(DISTINCT query_id), 10000) AS ids,
 CAST(0 AS BIGINT) AS strangers
FROM query_log
"""))
def s17_size(spark, sf_dir):
    """The sample has its exact size and holds log rows only, each at most once."""
    log = query_log(spark, sf_dir)
    drawn = ordering.sample_n(log, 10_000, 42).select("query_id")
    known = log.select("query_id", F.lit(1).alias("known"))
    return drawn.join(known, "query_id", "left").agg(
        F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"),
        F.count_if(F.col("known").isNull()).alias("strangers"),
    )


# -- functions ----------------------------------------------------------------------


@query("f_times", """
SELECT query_id, CAST(date_trunc('day', arrival_timestamp) AS DATE) AS day,
 date_trunc('hour', arrival_timestamp) AS hour, date_trunc('minute', arrival_timestamp) AS minute,
 extract(minute FROM arrival_timestamp) AS minute_no,
 strftime(arrival_timestamp, '%Y-%m-%d') AS shown,
 strftime(arrival_timestamp, '%Y_%m_%d') AS suffix,
 CAST(CAST(arrival_timestamp AS DATE) + 1 AS DATE) AS next,
 CAST(CAST(arrival_timestamp AS DATE) - 4 AS DATE) AS expired,
 strftime(arrival_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS iso
FROM query_log
""")
def f_times(log):
    ts = "arrival_timestamp"
    return log.select(
        "query_id", times.day_of(ts).alias("day"),
        times.floor_to(log, ts, "hour").alias("hour"),
        times.floor_to(log, ts, "minute").alias("minute"),
        times.minute_of(ts).cast("bigint").alias("minute_no"),
        times.format_time(F.col(ts), "yyyy-MM-dd").alias("shown"),
        times.format_time(F.col(ts), "yyyy_MM_dd").alias("suffix"),
        times.shift_days(times.day_of(ts), 1).alias("next"),
        times.shift_days(times.day_of(ts), -4).alias("expired"),
        times.iso_text(F.col(ts)).alias("iso"),
    )


@query("f_texts", """
SELECT query_id, len(string_split(nullif(read_table_ids, ''), ',')) AS ids,
 read_table_ids || ',' || write_table_ids AS joined,
 concat_ws(' | ', query_type, read_table_ids) AS messages,
 array_to_string(list_sort(list_intersect(
  string_split(coalesce(read_table_ids, ''), ','), ['00', '000', '0000'])), ',') AS bad
FROM query_log
""")
def f_texts(log):
    reads, writes = F.col("read_table_ids"), F.col("write_table_ids")
    return log.select(
        "query_id", F.size(lists.split_ids(reads)).cast("bigint").alias("ids"),
        lists.concat_lists(reads, writes).alias("joined"),
        lists.join_texts([F.col("query_type"), reads]).alias("messages"),
        F.coalesce(
            F.array_join(lists.common_ids(reads, ["00", "000", "0000"]), ","), F.lit("")
        ).alias("bad"),
    )


@query("f_numbers", """
SELECT query_id, round(ln(1 + compile_duration_ms), 6) AS logged,
 round(exp(num_scans) - 1, 6) AS unlogged, round(exp(num_scans * 0.5), 6) AS grown,
 pow(num_scans, 2) AS squared, nullif(num_scans, 0) AS nonzero,
 TRY_CAST(query_type AS DOUBLE) AS number, CAST(num_joins AS DOUBLE) AS joins
FROM query_log
""")
def f_numbers(log):
    scans = F.col("num_scans")
    return rounded(log.select(
        "query_id", numbers.log_scale(F.col("compile_duration_ms")).alias("logged"),
        numbers.unlog_scale(scans).alias("unlogged"), F.exp(scans * 0.5).alias("grown"),
        F.pow(scans, F.lit(2)).alias("squared"), F.nullif(scans, F.lit(0)).alias("nonzero"),
        casts.to_num_lenient(F.col("query_type")).alias("number"),
        F.col("num_joins").cast("double").alias("joins"),
    ), "logged", "unlogged", "grown")
