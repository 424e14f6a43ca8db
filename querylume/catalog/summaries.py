"""The maintained summaries, computed in one go."""

from pyspark.sql import functions as F

from querylume.catalog.core import query, rounded
from querylume.operators.joins import join_day_totals, join_unique
from querylume.operators.projections import with_day
from querylume.operators.quality import duplicate_keys
from querylume.plans import views

ACCESSES = """
, accesses AS (
 SELECT arrival_timestamp, CAST(arrival_timestamp AS DATE) AS day, query_type, user_id,
  unnest(string_split(nullif(read_table_ids, ''), ',')) AS table_id FROM query_log
 UNION ALL
 SELECT arrival_timestamp, CAST(arrival_timestamp AS DATE), query_type, user_id,
  unnest(string_split(nullif(write_table_ids, ''), ',')) FROM query_log
)
"""

M1 = ACCESSES + """
, groups AS (
 SELECT day, table_id, query_type, user_id, count(*) AS count FROM accesses
 GROUP BY day, table_id, query_type, user_id
)
, totals AS (SELECT day, sum(count) AS total FROM groups GROUP BY day)
, m1 AS (
 SELECT g.day, table_id, query_type, user_id, count,
  CAST(count AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS percentage,
  CAST(count AS DOUBLE) / CAST((SELECT sum(total) FROM totals) AS DOUBLE) * 100
   AS overall_percentage
 FROM groups g JOIN totals t ON g.day = t.day
)
"""

M3 = """
, groups AS (
 SELECT CAST(arrival_timestamp AS DATE) AS day, query_type, user_id, count(*) AS count
 FROM query_log WHERE query_type IS NOT NULL GROUP BY 1, 2, 3
)
, totals AS (SELECT day, sum(count) AS total FROM groups GROUP BY day)
, m3 AS (
 SELECT g.day, query_type, user_id, count,
  CAST(count AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS daily_percentage,
  CAST(count AS DOUBLE) / CAST((SELECT sum(total) FROM totals) AS DOUBLE) * 100
   AS overall_percentage
 FROM groups g JOIN totals t ON g.day = t.day
)
"""

M4 = """
, stats AS (
 SELECT CAST(arrival_timestamp AS DATE) AS day, query_type, user_id,
  count(*) FILTER (WHERE was_cached = 1) AS was_cached_count, count(*) AS total_count
 FROM query_log GROUP BY 1, 2, 3
)
, totals AS (
 SELECT day, CAST(sum(total_count) AS BIGINT) AS total_queries FROM stats GROUP BY day
)
, m4 AS (
 SELECT s.day, query_type, user_id, was_cached_count, total_queries,
  CAST(was_cached_count AS DOUBLE) / CAST(total_queries AS DOUBLE) * 100 AS hit_rate_per_day
 FROM stats s JOIN totals t ON s.day = t.day
)
"""

M5 = """
, m5 AS (
 SELECT num_joins AS x, avg(compile_duration_ms) AS y FROM query_log
 WHERE query_type = 'select' AND num_joins IS NOT NULL GROUP BY num_joins
)
"""
M5_ROWS = M5 + "SELECT x, round(y, 6) AS y FROM m5"


@query("m1_table_access_daily", M1 + "SELECT * FROM m1")
def m1(log):
    return views.table_access_daily(log)


@query("m2_table_access_rows", ACCESSES + """
, groups AS (SELECT day, table_id, count(*) AS count FROM accesses GROUP BY day, table_id)
, totals AS (SELECT day, sum(count) AS total FROM groups GROUP BY day)
, shares AS (
 SELECT g.day, table_id, count,
  CAST(count AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS percentage,
  CAST(count AS DOUBLE) / CAST((SELECT sum(total) FROM totals) AS DOUBLE) * 100
   AS overall_percentage
 FROM groups g JOIN totals t ON g.day = t.day
)
SELECT arrival_timestamp, day, table_id, count, percentage, overall_percentage
FROM accesses JOIN shares USING (day, table_id)
""")
def m2(log):
    return views.table_access_rows(log)


@query("m3_query_types_daily", M3 + "SELECT * FROM m3")
def m3(log):
    return views.query_types_daily(log)


@query("m4_hit_rate_daily", M4 + "SELECT * FROM m4")
def m4(log):
    return views.hit_rate_daily(log)


@query("m5_compile_by_joins", M5_ROWS)
def m5(log):
    return rounded(views.compile_by_joins(log), "y")


@query("m5_compile_by_joins_range", """
SELECT num_joins AS x, round(avg(compile_duration_ms), 6) AS y FROM query_log
WHERE query_type = 'select' AND num_joins IS NOT NULL
 AND arrival_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
GROUP BY num_joins
""")
def m5_range(log):
    return rounded(views.compile_by_joins(log, "2024-01-05", "2024-01-20"), "y")


@query("j1_day_totals", """
SELECT query_id, CAST(arrival_timestamp AS DATE) AS day, n FROM query_log q
JOIN (SELECT CAST(arrival_timestamp AS DATE) AS d, count(*) AS n FROM query_log GROUP BY 1) t
ON CAST(q.arrival_timestamp AS DATE) = t.d
""")
def j1(log):
    rows = with_day(log).select("query_id", "day")
    return join_day_totals(rows, rows.groupBy("day").agg(F.count("*").alias("n")))


@query("j2_join_unique", """
SELECT query_id, query_type, user_id, n FROM query_log
JOIN (SELECT query_type, user_id, count(*) AS n FROM query_log GROUP BY ALL) t
USING (query_type, user_id)
""")
def j2(log):
    rows = log.select("query_id", "query_type", "user_id")
    lookup = rows.groupBy("query_type", "user_id").agg(F.count("*").alias("n"))
    return join_unique(rows, lookup, ["query_type", "user_id"], "n")


@query("v11_duplicate_keys", """
SELECT user_id, query_type, count(*) AS count FROM query_log
GROUP BY user_id, query_type HAVING count(*) > 1
""")
def v11(log):
    return duplicate_keys(log, ["user_id", "query_type"])


@query("v11_summary_keys_unique", M1 + """
SELECT day, table_id, query_type, user_id, count(*) AS count FROM m1
GROUP BY day, table_id, query_type, user_id HAVING count(*) > 1
""")
def v11_m1(log):
    return duplicate_keys(
        views.table_access_daily(log), ["day", "table_id", "query_type", "user_id"]
    )
