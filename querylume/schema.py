"""Columns, types and fixed values of a warehouse query log."""

from pyspark.sql import types as T

# The columns of a streamed log row with the type name each value
# is checked against (the names appear in anomaly messages).
EXPECTED_TYPES = {
    "user_id": "int",
    "query_id": "int",
    "arrival_timestamp": "datetime64[ns]",
    "compile_duration_ms": "float",
    "execution_duration_ms": "int",
    "was_cached": "int",
    "query_type": "str",
    "read_table_ids": "str",
    "write_table_ids": "str",
    "num_joins": "int",
    "num_scans": "int",
}

# Legal query types, and table ids that mark a broken log line.
LEGAL_QUERY_TYPES = [
    "select", "insert", "delete", "other", "analyze",
    "unload", "update", "copy", "ctas", "vacuum",
]
INVALID_TABLE_IDS = ["00", "000", "0000"]

# Query types that must name the tables they read or write.
READING_TYPES = ["select", "copy"]
WRITING_TYPES = ["insert", "delete", "copy"]

# Columns only the raw file has, dropped before streaming. "rn" is
# the row number an earlier sort may leave behind.
RAW_ONLY_COLUMNS = [
    "mbytes_scanned",
    "instance_id",
    "cluster_size",
    "database_id",
    "queue_duration_ms",
    "feature_fingerprint",
    "was_aborted",
    "cache_source_query_id",
    "num_permanent_tables_accessed",
    "num_external_tables_accessed",
    "num_system_tables_accessed",
    "mbytes_spilled",
    "num_aggregations",
    "rn",
]

# Rows per stream message, rows of a preview, days kept.
ROWS_PER_MESSAGE = 800
PREVIEW_ROWS = 20
DAYS_KEPT = 4

STREAM_COLUMNS = list(EXPECTED_TYPES)

LOG_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("arrival_timestamp", T.TimestampType()),
    T.StructField("compile_duration_ms", T.DoubleType()),
    T.StructField("execution_duration_ms", T.DoubleType()),
    T.StructField("was_cached", T.IntegerType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("read_table_ids", T.StringType()),
    T.StructField("write_table_ids", T.StringType()),
    T.StructField("num_joins", T.IntegerType()),
    T.StructField("num_scans", T.IntegerType()),
])

# Rows as they come out of a message: every value still text, so that a value of
# the wrong type can be reported instead of silently becoming null.
TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STREAM_COLUMNS])

ANOMALY_SCHEMA = T.StructType([
    T.StructField("arrival_timestamp", T.TimestampType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("anomaly_description", T.StringType()),
])
