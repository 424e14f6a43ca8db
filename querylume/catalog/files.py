"""Scans, writes and messages: what is written is read back and compared."""

import uuid

from pyspark.sql import functions as F

from querylume.catalog.core import (
    ONLY_LOG_ROWS, log_sql, only_log_rows, query, table_query, written_table,
)
from querylume.fixture import query_log
from querylume.operators.cleaning import conform
from querylume.operators.projections import drop_raw_only
from querylume.plans.checks import sort_check
from querylume.session import scratch_path
from querylume.sources import files, jdbc, messages

TYPED_ROWS = """
SELECT user_id, query_id, arrival_timestamp, compile_duration_ms,
 CAST(execution_duration_ms AS DOUBLE) AS execution_duration_ms, was_cached, query_type,
 read_table_ids, write_table_ids, num_joins, num_scans FROM query_log
"""


@table_query("s1_parquet_scan", "SELECT * FROM events")
def s1(spark, sf_dir):
    return files.read_log(spark, f"{sf_dir}/events.parquet")


@table_query("s2_describe_schema", """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name,
 CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type
FROM (DESCRIBE events)
""")
def s2(spark, sf_dir):
    return files.describe_schema(files.read_log(spark, f"{sf_dir}/events.parquet"))


LOG_COLUMNS = (
    "query_id user_id arrival_timestamp compile_duration_ms execution_duration_ms was_cached"
    " query_type read_table_ids write_table_ids num_joins num_scans mbytes_scanned mbytes_spilled"
).split()


@query("s2_known_values", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS known, count(*) - count({c}) AS missing FROM query_log"
    for c in LOG_COLUMNS))
def s2_known(log):
    return files.known_values(log)


@query("s2_preview", ONLY_LOG_ROWS.format(n=20))
def s2_preview(log):
    return only_log_rows(files.preview(log), log)


@table_query("s3_row_count", "SELECT count(*) AS n FROM events")
def s3(spark, sf_dir):
    return files.read_log(spark, f"{sf_dir}/events.parquet").agg(F.count("*").alias("n"))


@table_query("s4_csv_round_trip", "SELECT * FROM orders")
def s4(spark, sf_dir):
    rows, path = files.read_log(spark, f"{sf_dir}/orders.parquet"), scratch_path(spark, "csv")
    files.export_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@table_query("s5_write_sorted", log_sql("SELECT * FROM query_log"))
def s5(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    files.write_sorted(query_log(spark, sf_dir), path)
    return files.read_log(spark, path)


@table_query("s5_sorted_files_are_in_order", """
SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, CAST(0 AS BIGINT) AS out_of_order
FROM orders
""")
def s5_check(spark, sf_dir):
    """Sort a file that is out of order, then check the files written."""
    path = scratch_path(spark, "sorted")
    files.write_sorted(files.read_log(spark, f"{sf_dir}/orders.parquet"), path, "o_orderdate")
    return sort_check(spark, path, "o_orderdate")


@table_query("s6_save_table", log_sql("SELECT * FROM query_log"))
def s6(spark, sf_dir):
    name = f"log_{uuid.uuid4().hex}"
    files.save_table(query_log(spark, sf_dir), name, path=scratch_path(spark, "table"))
    return spark.table(name)


@table_query("s7_jdbc_column_types", "SELECT * FROM events")
def s7(spark, sf_dir):
    """The rows as read with the column types a database table would be made with: a
    table created from that text holds them all."""
    rows = files.read_log(spark, f"{sf_dir}/events.parquet")
    path = scratch_path(spark, "typed")
    rows.write.parquet(path)
    return spark.read.schema(jdbc.jdbc_column_types(rows.schema)).parquet(path)


@query("s12_message_round_trip", TYPED_ROWS)
def s12(log):
    """Rows to JSON-array messages and back."""
    sent = messages.to_batches(log)
    return conform(messages.rows_of(messages.parsed(sent.select("value"))))


@query("s12_message_sizes", """
SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT query_id) AS ids, TRUE AS within_limit
FROM query_log
""")
def s12_sizes(log):
    """No message holds more rows than asked for, and every row is sent once."""
    decoded = messages.parsed(messages.to_batches(log, 800))
    sizes = decoded.select(F.size("rows").alias("n"), F.inline("rows"))
    return sizes.agg(
        F.count("*").alias("rows"), F.count_distinct("query_id").alias("ids"),
        (F.max("n") <= 800).alias("within_limit"),
    )


@query("s13_row_messages", TYPED_ROWS)
def s13(log):
    """Rows to one JSON object each and back."""
    sent = messages.to_messages(drop_raw_only(log), n=None)
    return conform(messages.rows_of(messages.parsed(sent)))


@query("s16_cached", "SELECT was_cached, count(*) AS count FROM query_log GROUP BY was_cached")
def s16(log):
    """Both readings come from the kept frame, which is let go afterwards."""
    kept = files.cached(log.select("was_cached"))
    try:
        counts = kept.groupBy("was_cached").agg(F.count("*").alias("count"))
        return written_table(counts)
    finally:
        kept.unpersist()


@query("f_json", """
SELECT query_id, query_type, strftime(arrival_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS at,
 num_joins FROM query_log
""")
def f_json(log):
    """Encode to JSON bytes, decode to text, parse."""
    cols = ["query_id", "query_type", "arrival_timestamp", "num_joins"]
    as_bytes = F.encode(F.to_json(F.struct(*cols), messages.JSON_OPTIONS), "UTF-8")
    schema = "query_id bigint, query_type string, arrival_timestamp string, num_joins int"
    return log.select(F.from_json(as_bytes.cast("string"), schema).alias("r")).select(
        "r.query_id", "r.query_type", F.col("r.arrival_timestamp").alias("at"), "r.num_joins"
    )
