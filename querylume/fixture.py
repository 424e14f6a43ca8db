"""The test and benchmark log: a view over the driver's ``events`` table."""

from pyspark.sql import DataFrame, functions as F

# How an event becomes a log row. The same text runs in Spark and in
# the SQL the results are checked against.
COLUMNS = {
    "query_id": "event_id",
    "user_id": "user_id",
    "arrival_timestamp": "ts",
    "compile_duration_ms": "CASE WHEN k % 19 = 0 THEN NULL ELSE value END",
    "execution_duration_ms": (
        "CASE WHEN k = 13 THEN -1 WHEN k % 11 = 0 THEN 0"
        " ELSE CAST(floor(value * 10) AS BIGINT) END"
    ),
    "was_cached": "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END",
    "query_type": (
        "CASE WHEN k = 41 THEN 'bogus' WHEN event_type = 'view' THEN 'select'"
        " WHEN event_type = 'click' THEN 'insert' WHEN event_type = 'signup' THEN 'copy'"
        " WHEN event_type = 'error' THEN 'delete' ELSE 'update' END"
    ),
    "read_table_ids": (
        "CASE WHEN k % 7 = 0 THEN NULL WHEN k = 59 THEN '00'"
        " WHEN k % 5 = 0 THEN CAST(k % 20 AS STRING)"
        " ELSE CAST(k % 20 AS STRING) || ',' || CAST(20 + user_id % 10 AS STRING) END"
    ),
    "write_table_ids": (
        "CASE WHEN event_type = 'view' OR k % 13 = 0 THEN NULL WHEN k = 61 THEN ''"
        " ELSE CAST(user_id % 30 AS STRING) END"
    ),
    "num_joins": "CASE WHEN k % 17 = 0 THEN NULL ELSE k % 8 END",
    "num_scans": "k % 5",
    "mbytes_scanned": "value * 3",
    "mbytes_spilled": "CASE WHEN k % 4 = 0 THEN value ELSE 0.0 END",
}
EVENT_KEY = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"


def query_log_of(events: DataFrame) -> DataFrame:
    """Log rows of a batch or streaming ``events`` frame."""
    keyed = events.withColumn("k", F.expr(EVENT_KEY))
    return keyed.selectExpr(*[f"{expr} AS {name}" for name, expr in COLUMNS.items()])


def query_log(spark, sf_dir: str) -> DataFrame:
    return query_log_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def query_log_sql() -> str:
    """The same view as the body of a CTE."""
    cols = ",\n ".join(f"{expr} AS {name}" for name, expr in COLUMNS.items())
    return f"SELECT {cols}\nFROM (SELECT *, {EVENT_KEY} AS k FROM events) e"
