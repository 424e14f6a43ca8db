"""Casts, projections, filters and exploding lists."""

from pyspark.sql import functions as F

from querylume.catalog.core import query, table_query
from querylume.functions import casts
from querylume.operators import cleaning, filters, projections
from querylume.operators.explode import explode_accesses, explode_ids, explode_read_write
from querylume.schema import STREAM_COLUMNS
from querylume.sources.files import read_log

# Log rows as text in which some values do not fit their column.
TEXT_LOG = """
, texts AS (
 SELECT query_id,
  CASE WHEN query_type = 'copy' THEN query_type
   ELSE strftime(arrival_timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS stamp,
  CASE WHEN query_type = 'bogus' THEN 'NaN' WHEN query_type = 'copy' THEN query_type
   ELSE CAST(num_scans AS VARCHAR) || '.5' END AS amount
 FROM query_log
)
"""


def text_log(log):
    kind = F.col("query_type")
    stamp = F.date_format("arrival_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    amount = F.concat(F.col("num_scans").cast("string"), F.lit(".5"))
    return log.select(
        "query_id",
        F.when(kind == "copy", kind).otherwise(stamp).alias("stamp"),
        F.when(kind == "bogus", "NaN").when(kind == "copy", kind).otherwise(amount).alias("amount"),
    )


@query("p1_drop_raw_only", f"SELECT {', '.join(STREAM_COLUMNS)} FROM query_log")
def p1(log):
    return projections.drop_raw_only(log)


@query("p2_project", "SELECT query_id, query_type, was_cached FROM query_log")
def p2(log):
    return projections.project(log, ["query_id", "query_type", "was_cached"])


@query("p3_to_ts_lenient", TEXT_LOG + "SELECT query_id, TRY_CAST(stamp AS TIMESTAMP) AS stamp FROM texts")
def p3(log):
    return text_log(log).select("query_id", casts.to_ts_lenient(F.col("stamp")).alias("stamp"))


@query("p4_to_ts_strict", """
SELECT query_id, CAST(CAST(arrival_timestamp AS VARCHAR) AS TIMESTAMP) AS stamp FROM query_log
""")
def p4(log):
    text = F.col("arrival_timestamp").cast("string")
    return log.select("query_id", casts.to_ts_strict(text).alias("stamp"))


@query("p5_to_num_lenient", TEXT_LOG + """
SELECT query_id, CASE WHEN isnan(n) THEN -1 ELSE n END AS n
FROM (SELECT query_id, TRY_CAST(amount AS DOUBLE) AS n FROM texts)
""")
def p5(log):
    n = casts.to_num_lenient(F.col("amount"))
    return text_log(log).select("query_id", F.nanvl(n, F.lit(-1.0)).alias("n"))


@query("p6_to_text", """
SELECT query_id, CAST(num_joins AS VARCHAR) AS joins, read_table_ids FROM query_log
""")
def p6(log):
    return log.select(
        "query_id", casts.to_text(F.col("num_joins")).alias("joins"),
        casts.to_text(F.col("read_table_ids")).alias("read_table_ids"),
    )


@query("p7_nan_to_null", TEXT_LOG + """
SELECT query_id, CASE WHEN NOT isnan(n) THEN n END AS n
FROM (SELECT query_id, TRY_CAST(amount AS DOUBLE) AS n FROM texts)
""")
def p7(log):
    n = casts.nan_to_null(casts.to_num_lenient(F.col("amount")))
    return text_log(log).select("query_id", n.alias("n"))


@query("p8_null_to_empty", """
SELECT query_id, coalesce(read_table_ids, '') AS reads, coalesce(write_table_ids, '') AS writes
FROM query_log
""")
def p8(log):
    return log.select(
        "query_id", casts.null_to_empty(F.col("read_table_ids")).alias("reads"),
        casts.null_to_empty(F.col("write_table_ids")).alias("writes"),
    )


@query("p9_clean_log", TEXT_LOG + """
SELECT * FROM texts WHERE stamp IS NOT NULL AND TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL
""")
def p9(log):
    return cleaning.clean_log(text_log(log), "stamp")


@query("p9_conform", """
SELECT user_id, query_id, arrival_timestamp, compile_duration_ms,
 CAST(execution_duration_ms AS DOUBLE) AS execution_duration_ms, was_cached, query_type,
 read_table_ids, write_table_ids, num_joins, num_scans FROM query_log
""")
def conform(log):
    return cleaning.conform(log)


@query("p10_with_day", "SELECT query_id, CAST(arrival_timestamp AS DATE) AS day FROM query_log")
def p10(log):
    return projections.with_day(log).select("query_id", "day")


@query("p11_between_ts", """
SELECT query_id, arrival_timestamp FROM query_log
WHERE arrival_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
""")
def p11(log):
    rows = filters.between_ts(log, "2024-01-05", "2024-01-20")
    return rows.select("query_id", "arrival_timestamp")


@query("p12_between_days", """
SELECT query_id, arrival_timestamp FROM query_log
WHERE CAST(arrival_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
""")
def p12(log):
    rows = filters.between_days(projections.with_day(log), "2024-01-05", "2024-01-20")
    return rows.select("query_id", "arrival_timestamp")


@query("p13_where_optional", """
SELECT query_id, query_type, user_id FROM query_log WHERE query_type = 'copy' AND user_id = 7
""")
def p13(log):
    return filters.where_optional(log, "copy", 7).select("query_id", "query_type", "user_id")


@query("p13_where_optional_none", "SELECT query_id FROM query_log")
def p13_none(log):
    return filters.where_optional(log, "All", None).select("query_id")


@query("p14_latest_day", """
SELECT query_id, arrival_timestamp FROM query_log WHERE CAST(arrival_timestamp AS DATE) =
 (SELECT max(CAST(arrival_timestamp AS DATE)) FROM query_log)
""")
def p14(log):
    return filters.latest_day(log).select("query_id", "arrival_timestamp")


@query("p15_minute_multiple", """
SELECT query_id, arrival_timestamp FROM query_log
WHERE extract(minute FROM arrival_timestamp) % 5 = 0
""")
def p15(log):
    return filters.minute_multiple(log, 5).select("query_id", "arrival_timestamp")


@query("p16_present", """
SELECT query_id, compile_duration_ms, num_joins FROM query_log
WHERE compile_duration_ms IS NOT NULL AND NOT isnan(compile_duration_ms) AND num_joins IS NOT NULL
""")
def p16(log):
    rows = filters.present(log, "compile_duration_ms", "num_joins")
    return rows.select("query_id", "compile_duration_ms", "num_joins")


@query("p17_of_type", "SELECT query_id FROM query_log WHERE lower(query_type) = 'select'")
def p17(log):
    return filters.of_type(log, "SELECT").select("query_id")


SPELLINGS = ["select", "SELECT", "Select", "sElect", "SeLeCt"]


@query("p17_of_type_any_case", """
SELECT query_id FROM query_log WHERE lower(query_type) IN ('select', 'copy')
""")
def p17_any_case(log):
    """Both types logged in five spellings, dealt by id."""
    place = F.pmod(F.col("query_id"), F.lit(5)).cast("int")
    spelt = F.when(F.col("query_type") == "select", F.element_at(F.array(*map(F.lit, SPELLINGS)), place + 1)).when(
        F.col("query_type") == "copy", F.element_at(F.array(*map(F.lit, ["copy", "COPY", "cOPY", "Copy", "copY"])), place + 1))
    odd = log.withColumn("query_type", F.coalesce(spelt, "query_type"))
    return filters.of_type(odd, "Select").unionByName(filters.of_type(odd, "coPy")).select("query_id")


@query("p18_col_in", "SELECT query_id FROM query_log WHERE query_type IN ('select', 'copy')")
def p18(log):
    return log.filter(filters.col_in(F.col("query_type"), ["select", "copy"])).select("query_id")


@query("p19_in_month", """
SELECT query_id FROM query_log WHERE strftime(arrival_timestamp, '%Y-%m') = '2024-01'
""")
def p19(log):
    return filters.in_month(log, "2024-01").select("query_id")


@query("p20_after", """
SELECT query_id FROM query_log WHERE arrival_timestamp > TIMESTAMP '2024-01-15 12:00:00'
""")
def p20(log):
    return filters.after(log, "2024-01-15 12:00:00").select("query_id")


@query("p21_require_columns", "SELECT num_joins, num_scans FROM query_log")
def p21(log):
    return projections.require_columns(log, ["num_joins", "num_scans"]).select(
        "num_joins", "num_scans"
    )


@query("p22_relabel", """
SELECT query_id, CASE was_cached WHEN 0 THEN 'Not Cached' WHEN 1 THEN 'Cached' END AS was_cached
FROM query_log
""")
def p22(log):
    labels = {"0": "Not Cached", "1": "Cached"}
    return log.select(
        "query_id", projections.relabel(F.col("was_cached"), labels).alias("was_cached")
    )


@query("p23_rename", 'SELECT query_id AS "Query", query_type AS "Query Type" FROM query_log')
def p23(log):
    named = projections.rename(log, {"query_id": "Query", "query_type": "Query Type"})
    return named.select("Query", "Query Type")


@query("p24_unpivot", """
SELECT query_id, 'num_joins' AS metric, num_joins AS n FROM query_log
UNION ALL SELECT query_id, 'num_scans', num_scans FROM query_log
""")
def p24(log):
    return projections.unpivot(log, ["query_id"], ["num_joins", "num_scans"], "metric", "n")


@query("p25_explode_ids", """
SELECT query_id, unnest(string_split(nullif(write_table_ids, ''), ',')) AS table_id FROM query_log
""")
def p25(log):
    return explode_ids(log, "write_table_ids", keep=["query_id"])


@query("p26_explode_read_ids", """
SELECT query_id, unnest(string_split(nullif(read_table_ids, ''), ',')) AS table_id FROM query_log
""")
def p26(log):
    return explode_ids(log, "read_table_ids", keep=["query_id"])


@query("p27_explode_read_write", """
SELECT query_id, unnest(string_split(read_table_ids || ',' || write_table_ids, ',')) AS table_id
FROM query_log
""")
def p27(log):
    return explode_read_write(log)


@query("p27_explode_read_write_one_sided", """
SELECT query_id, unnest(string_split(nullif(
 concat_ws(',', nullif(read_table_ids, ''), nullif(write_table_ids, '')), ''), ',')) AS table_id
FROM query_log
""")
def p27_one_sided(log):
    return explode_read_write(log, include_one_sided=True)


UNION_OF_ACCESSES = """
SELECT query_id, unnest(string_split(nullif(read_table_ids, ''), ',')) AS table_id FROM query_log
UNION ALL
SELECT query_id, unnest(string_split(nullif(write_table_ids, ''), ',')) AS table_id FROM query_log
"""


@query("u1_union_all", UNION_OF_ACCESSES)
def u1(log):
    return projections.union_all(
        explode_ids(log, "read_table_ids", keep=["query_id"]),
        explode_ids(log, "write_table_ids", keep=["query_id"]),
    )


@query("u1_accesses_in_one_scan", UNION_OF_ACCESSES)
def u1_single(log):
    return explode_accesses(log, ["query_id"])


@table_query("u2_union_of_files", """
SELECT event_id, ts, user_id, event_type, value, props FROM events
UNION ALL SELECT event_id, ts, user_id, event_type, value, props FROM events
""")
def u2(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return read_log(spark, path, path)
