"""Named queries over the driver's tables, each next to the SQL it is checked with.

A query takes ``(spark, sf_dir)``. Its SQL sees the log as the CTE ``query_log``.
Sums and means of doubles are rounded on both sides, since the order of addition
differs between engines; ratios of counts are not.
"""

from pyspark.sql import DataFrame, functions as F

from querylume.fixture import query_log, query_log_sql
from querylume.session import scratch_path

QUERIES = {}
ORACLES = {}
PLACES = 6


def query(name, sql=None):
    """Register a query of the log: the function gets the log frame."""
    def add(fn):
        def run(spark, sf_dir):
            return fn(query_log(spark, sf_dir))
        return _add(name, run, log_sql(sql) if sql else None, fn)
    return add


def table_query(name, sql=None):
    """Register a query that picks its own tables: the function gets
    ``(spark, sf_dir)`` and its SQL is taken as it is."""
    def add(fn):
        return _add(name, fn, sql, fn)
    return add


def _add(name, run, sql, fn):
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql.strip()
    return fn


def log_sql(body: str) -> str:
    """``body`` with the log in front; further CTEs start with a comma."""
    body = body.strip()
    joint = "" if body.startswith(",") else "\n"
    return f"WITH query_log AS (\n{query_log_sql()}\n){joint}{body}"


def rounded(df: DataFrame, *cols, places=PLACES) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


# Some rows of the log, any of them: how many, how many ids, and how many are not its rows.
ONLY_LOG_ROWS = """
SELECT least(count(*), {n}) AS n, least(count(DISTINCT query_id), {n}) AS ids,
 CAST(0 AS BIGINT) AS strangers
FROM query_log
"""


def only_log_rows(some: DataFrame, log: DataFrame) -> DataFrame:
    known = log.distinct().withColumn("known", F.lit(1))
    same = [some[c].eqNullSafe(known[c]) for c in log.columns]
    return some.join(known, same, "left").agg(
        F.count("*").alias("n"), F.count_distinct(some["query_id"]).alias("ids"),
        F.count_if(F.col("known").isNull()).alias("strangers"),
    )


def written_table(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
