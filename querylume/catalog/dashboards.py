"""The dashboard queries."""

from querylume.catalog.core import ORACLES, log_sql, query, rounded, table_query
from querylume.catalog.streams import refreshed
from querylume.catalog.summaries import M1, M3, M4
from querylume.fixture import query_log, query_log_sql
from querylume.operators.ordering import recent
from querylume.plans import reports, views
from querylume.plans.checks import sort_check

LATEST = """
, latest AS (
 SELECT * FROM query_log WHERE CAST(arrival_timestamp AS DATE) =
  (SELECT max(CAST(arrival_timestamp AS DATE)) FROM query_log)
)
"""


@query("q1_cached_counts", """
SELECT was_cached, count(*) AS count FROM query_log WHERE was_cached IS NOT NULL GROUP BY 1
""")
def q1(log):
    return reports.cached_counts(log)


@query("q2_hourly_durations", """
SELECT date_trunc('hour', arrival_timestamp) AS hour,
 round(avg(compile_duration_ms), 6) AS compile_duration_ms,
 round(avg(execution_duration_ms), 6) AS execution_duration_ms
FROM query_log WHERE arrival_timestamp IS NOT NULL GROUP BY 1
""")
def q2(log):
    return rounded(reports.hourly_durations(log), "compile_duration_ms", "execution_duration_ms")


@query("q3_exec_by_type_cached", """
SELECT query_type, CASE was_cached WHEN 0 THEN 'Not Cached' WHEN 1 THEN 'Cached'
  ELSE CAST(was_cached AS VARCHAR) END AS was_cached,
 round(avg(execution_duration_ms), 6) AS avg_execution_time_ms
FROM query_log WHERE query_type IS NOT NULL AND was_cached IS NOT NULL
GROUP BY query_type, query_log.was_cached
""")
def q3(log):
    return rounded(reports.exec_by_type_cached(log), "avg_execution_time_ms")


@query("q4_joins_scans_by_type", """
, means AS (
 SELECT query_type, avg(num_joins) AS j, avg(num_scans) AS s FROM query_log
 WHERE query_type IS NOT NULL GROUP BY query_type
)
SELECT query_type, 'avg_joins' AS "Metric", round(j, 6) AS "Average Count" FROM means
UNION ALL SELECT query_type, 'avg_scans', round(s, 6) FROM means
""")
def q4(log):
    return rounded(reports.joins_scans_by_type(log), "Average Count")


@query("q5_headline", """
SELECT count(*) AS total_queries,
 CAST(sum(was_cached) AS DOUBLE) / count(*) * 100 AS cache_hit_rate,
 round(avg(compile_duration_ms), 6) AS avg_compile_time,
 max(CAST(arrival_timestamp AS DATE)) AS latest_query_date
FROM query_log
""")
def q5(log):
    return rounded(reports.headline(log), "avg_compile_time")


@query("q6_headline_range", """
, part AS (
 SELECT * FROM query_log
 WHERE arrival_timestamp >= TIMESTAMP '2024-01-05' AND arrival_timestamp <= TIMESTAMP '2024-01-20'
)
SELECT count(*) AS total_queries,
 CAST(sum(was_cached) AS DOUBLE) / count(*) * 100 AS cache_hit_rate,
 round(avg(compile_duration_ms), 6) AS avg_compile_time,
 (SELECT query_type FROM part WHERE query_type IS NOT NULL GROUP BY query_type
  ORDER BY count(*) DESC, query_type LIMIT 1) AS most_frequent_query
FROM part
""")
def q6(log):
    return rounded(reports.headline_range(log, "2024-01-05", "2024-01-20"), "avg_compile_time")


@query("q7_fifth_minute_hit_rate", LATEST + """
SELECT date_trunc('minute', arrival_timestamp) AS minute,
 CAST(count(*) FILTER (WHERE was_cached = 1) AS DOUBLE) / nullif(count(*), 0) * 100
  AS total_hit_rate_per_5_minutes
FROM latest WHERE extract(minute FROM arrival_timestamp) % 5 = 0 GROUP BY 1
""")
def q7(log):
    return reports.fifth_minute_hit_rate(log)


@query("q8_latest_type_share", LATEST + """
SELECT query_type, count(DISTINCT query_id) AS count,
 CAST(count(DISTINCT query_id) AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM latest) * 100
  AS overall_percentage
FROM latest GROUP BY query_type ORDER BY count DESC, query_type LIMIT 8
""")
def q8(log):
    return reports.latest_type_share(log)


def _latest_tables(ids):
    return LATEST + f"""
, uses AS (SELECT query_id, unnest(string_split({ids}, ',')) AS table_id FROM latest)
SELECT table_id, count(DISTINCT query_id) AS count,
 CAST(count(DISTINCT query_id) AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM latest) * 100
  AS overall_percentage
FROM uses GROUP BY table_id
"""


@query("q9_latest_table_share", _latest_tables("read_table_ids || ',' || write_table_ids"))
def q9(log):
    return reports.latest_table_share(log)


@query("q9_latest_table_share_top10", _latest_tables(
    "read_table_ids || ',' || write_table_ids") + "ORDER BY count DESC, table_id LIMIT 10")
def q9_top(log):
    return reports.latest_table_share(log, k=10)


@query("q9_latest_table_share_one_sided", _latest_tables(
    "nullif(concat_ws(',', nullif(read_table_ids, ''), nullif(write_table_ids, '')), '')"))
def q9_one_sided(log):
    return reports.latest_table_share(log, include_one_sided=True)


def _top_of(source, cte, key, share, where, k):
    return cte + f"""
, picked AS (
 SELECT {key}, CAST(sum(count) AS BIGINT) AS count, sum({share}) AS {share} FROM {source}
 WHERE {where} GROUP BY {key}
)
SELECT {key}, count, round({share}, 6) AS {share},
 CAST(count AS DOUBLE) / (SELECT CAST(sum(count) AS DOUBLE) FROM picked) * 100
  AS overall_percentage
FROM picked ORDER BY count DESC, {key} LIMIT {k}
"""


RANGE = "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"


@table_query("q10_top_tables", log_sql(
    _top_of("m1", M1, "table_id", "percentage", RANGE, 10)))
def q10(spark, sf_dir):
    m1 = refreshed(spark, sf_dir).summary(spark, "table_access")
    return rounded(reports.top_tables(m1, "2024-01-05", "2024-01-20"), "percentage")


@table_query("q10_top_tables_of_type_and_user", log_sql(_top_of(
    "m1", M1, "table_id", "percentage",
    RANGE + " AND query_type = 'select' AND user_id = 7", 10)))
def q10_filtered(spark, sf_dir):
    m1 = refreshed(spark, sf_dir).summary(spark, "table_access")
    top = reports.top_tables(m1, "2024-01-05", "2024-01-20", "select", 7)
    return rounded(top, "percentage")


@table_query("q11_top_types", log_sql(
    _top_of("m3", M3, "query_type", "daily_percentage", RANGE, 5)))
def q11(spark, sf_dir):
    m3 = refreshed(spark, sf_dir).summary(spark, "query_types")
    return rounded(reports.top_types(m3, "2024-01-05", "2024-01-20"), "daily_percentage")


HITS_OF_RANGE = M4 + f"""
SELECT day, round(sum(hit_rate_per_day), 6) AS cache_hit_rate FROM m4 WHERE {RANGE}
"""


@table_query("q12_hit_rate_range", log_sql(HITS_OF_RANGE + "GROUP BY day"))
def q12(spark, sf_dir):
    m4 = refreshed(spark, sf_dir).summary(spark, "hit_rate")
    return rounded(reports.hit_rate_range(m4, "2024-01-05", "2024-01-20"), "cache_hit_rate")


@table_query("q12_hit_rate_range_of_type", log_sql(
    HITS_OF_RANGE + "AND query_type = 'select' GROUP BY day"))
def q12_filtered(spark, sf_dir):
    m4 = refreshed(spark, sf_dir).summary(spark, "hit_rate")
    rates = reports.hit_rate_range(m4, "2024-01-05", "2024-01-20", "select")
    return rounded(rates, "cache_hit_rate")


READS = """
, reads AS (
 SELECT query_id, unnest(string_split(nullif(read_table_ids, ''), ',')) AS table_id FROM query_log
)
"""


@query("q13_top_tables_by_reads", READS + """
, counts AS (SELECT table_id, count(*) AS n FROM reads GROUP BY table_id)
SELECT table_id AS "Table ID", n AS "Query Count",
 CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM counts) * 100 AS "Percentage"
FROM counts ORDER BY n DESC, table_id LIMIT 10
""")
def q13(log):
    return reports.top_tables_by_reads(log)


@query("q14_top_tables_by_queries", READS + """
, counts AS (SELECT table_id, count(DISTINCT query_id) AS n FROM reads GROUP BY table_id)
SELECT table_id AS "Table ID", n AS "Query Count",
 CAST(n AS DOUBLE) / (SELECT count(DISTINCT query_id) FROM query_log) * 100 AS "Percentage"
FROM counts ORDER BY n DESC, table_id LIMIT 10
""")
def q14(log):
    return reports.top_tables_by_queries(log)


@query("q15_hourly_counts", """
, hourly AS (
 SELECT date_trunc('hour', arrival_timestamp) AS h, count(query_id) AS n FROM query_log GROUP BY 1
)
SELECT c.h AS arrival_timestamp, coalesce(n, 0) AS query_id
FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hourly) c
LEFT JOIN hourly ON hourly.h = c.h
""")
def q15(log):
    return reports.hourly_counts(log)


@query("q16_type_counts", """
SELECT query_type AS "Query Type", count(*) AS "Count" FROM query_log
WHERE query_type IS NOT NULL GROUP BY 1
""")
def q16(log):
    return reports.type_counts(log)


def _calendar(daily):
    return f"""
, daily AS ({daily} FROM query_log GROUP BY 1)
, days AS (
 SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily
)
"""


@query("q17_rolling_scan_spill", _calendar(
    "SELECT CAST(arrival_timestamp AS DATE) AS day,"
    " sum(mbytes_scanned) AS a, sum(mbytes_spilled) AS b") + """
SELECT days.day AS arrival_timestamp,
 round(avg(coalesce(a, 0)) OVER w, 6) AS mbytes_scanned,
 round(avg(coalesce(b, 0)) OVER w, 6) AS mbytes_spilled
FROM days LEFT JOIN daily ON daily.day = days.day
WINDOW w AS (ORDER BY days.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def q17(log):
    return rounded(reports.rolling_scan_spill(log), "mbytes_scanned", "mbytes_spilled")


@query("q18_recent", """
SELECT query_id, query_type, execution_duration_ms, was_cached FROM query_log
ORDER BY arrival_timestamp DESC, query_id DESC LIMIT 10
""")
def q18(log):
    return recent(log, 10, ["query_id", "query_type", "execution_duration_ms", "was_cached"])


@query("q18_recent_with_users", """
SELECT query_id, user_id, execution_duration_ms, was_cached FROM query_log
ORDER BY arrival_timestamp DESC, query_id DESC LIMIT 20
""")
def q18_users(log):
    return recent(log, 20, ["query_id", "user_id", "execution_duration_ms", "was_cached"])


@query("q19_daily_hit_rate", _calendar(
    "SELECT CAST(arrival_timestamp AS DATE) AS day,"
    " CAST(sum(was_cached) AS BIGINT) AS hits, count(query_id) AS n") + """
SELECT days.day AS arrival_timestamp, coalesce(hits, 0) AS was_cached, coalesce(n, 0) AS query_id,
 CAST(hits AS DOUBLE) / nullif(n, 0) * 100 AS cache_hit_rate
FROM days LEFT JOIN daily ON daily.day = days.day
""")
def q19(log):
    return reports.daily_hit_rate(log)


@query("q20_rows_per_day", """
SELECT strftime(arrival_timestamp, '%Y-%m-%d') AS day, count(*) AS record_count FROM query_log
WHERE strftime(arrival_timestamp, '%Y-%m') = '2024-01' GROUP BY 1
""")
def q20(log):
    return reports.rows_per_day(log, "2024-01")


@table_query("q21_sort_check", """
SELECT min(ts) AS first, max(ts) AS last,
 count(*) FILTER (WHERE ts < before) AS out_of_order
FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)
""")
def q21(spark, sf_dir):
    """The events file holds its rows by id."""
    return sort_check(spark, f"{sf_dir}/events.parquet", "ts")


@table_query("q21_sort_check_unsorted", """
SELECT min(o_orderdate) AS first, max(o_orderdate) AS last,
 count(*) FILTER (WHERE o_orderdate < before) AS out_of_order
FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM orders)
""")
def q21_unsorted(spark, sf_dir):
    """The orders file holds its rows by key, so its dates are not in order."""
    return sort_check(spark, f"{sf_dir}/orders.parquet", "o_orderdate")


# -- logs with repeated ids and with gaps -------------------------------------------


def _variant(name, base, change, sql):
    """Query ``base`` over a changed log; ``sql`` is the same change of ``source``."""
    body = ORACLES[base].replace(
        f"WITH query_log AS (\n{query_log_sql()}\n)",
        f"WITH source AS (\n{query_log_sql()}\n), query_log AS ({sql})")
    run = {"q8": q8, "q9": q9, "q14": q14, "q15": q15, "q17": q17, "q19": q19}[base.split("_")[0]]
    table_query(name, body)(lambda spark, sf_dir: run(change(query_log(spark, sf_dir))))


def _repeated(log):
    return log.unionByName(log.filter("query_id % 3 = 0"))


for _base in ("q8_latest_type_share", "q9_latest_table_share", "q14_top_tables_by_queries"):
    _variant(f"{_base}_repeated_ids", _base, _repeated,
             "SELECT * FROM source UNION ALL SELECT * FROM source WHERE query_id % 3 = 0")

GAPS = "(extract(day FROM arrival_timestamp) BETWEEN 8 AND 12 OR extract(hour FROM arrival_timestamp) = 5)"
for _base in ("q15_hourly_counts", "q17_rolling_scan_spill", "q19_daily_hit_rate"):
    _variant(f"{_base}_with_gaps", _base, lambda log: log.filter(f"NOT {GAPS}"),
             f"SELECT * FROM source WHERE NOT {GAPS}")
