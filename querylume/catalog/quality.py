"""The data-quality rules, one by one and together."""

from pyspark.sql import functions as F

from querylume.catalog.core import query
from querylume.catalog.cleaning import TEXT_LOG, text_log
from querylume.operators import quality

LEGAL = (
    "('select', 'insert', 'delete', 'other', 'analyze',"
    " 'unload', 'update', 'copy', 'ctas', 'vacuum')"
)


def _hits(col):
    return (
        f"list_sort(list_intersect(string_split(coalesce({col}, ''), ','),"
        " ['00', '000', '0000']))"
    )


def _invalid(col):
    return (
        f"CASE WHEN len({_hits(col)}) > 0 THEN '{col} contains invalid values {{''' ||"
        f" array_to_string({_hits(col)}, ''', ''') || '''}}' END"
    )


RULES = {
    "v2": f"CASE WHEN coalesce(query_type, 'None') NOT IN {LEGAL}"
          " THEN 'Invalid query_type `' || coalesce(query_type, 'None') || '`' END",
    "v3": "CASE WHEN query_type IN ('select', 'copy') AND coalesce(read_table_ids, '') = ''"
          " THEN 'Missing read_table_ids for `' || query_type || '` query' END",
    "v4": "CASE WHEN query_type IN ('insert', 'delete', 'copy')"
          " AND coalesce(write_table_ids, '') = ''"
          " THEN 'Missing write_table_ids for `' || query_type || '` query' END",
    "v5": _invalid("read_table_ids"),
    "v6": _invalid("write_table_ids"),
    "v7": "CASE WHEN execution_duration_ms < 0 THEN 'execution_duration_ms is negative (' ||"
          " CAST(CAST(execution_duration_ms AS DOUBLE) AS VARCHAR) || ')' END",
    "v8": "CASE WHEN execution_duration_ms = 0 AND was_cached IS DISTINCT FROM 1"
          " THEN 'Query executed instantly but was not cached' END",
}


def found_sql(*rules):
    parts = ", ".join(RULES[r] for r in rules)
    return f"""
, found AS (
 SELECT arrival_timestamp, query_id, concat_ws(' | ', {parts}) AS anomaly_description
 FROM query_log
)
"""


ALL_FOUND = found_sql(*RULES)
FOUND_ROWS = "SELECT * FROM found WHERE anomaly_description <> ''"


def _one(rule):
    return found_sql(rule) + FOUND_ROWS


@query("v1_type_rule", TEXT_LOG + """
, wrong AS (
 SELECT query_id, CASE
  WHEN amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL
   THEN 'amount expected int, found text'
  WHEN NOT isnan(TRY_CAST(amount AS DOUBLE)) THEN 'amount expected int, found float' END AS amount,
  CASE WHEN stamp IS NOT NULL AND TRY_CAST(stamp AS TIMESTAMP) IS NULL
   THEN 'stamp expected datetime64[ns], found text' END AS stamp
 FROM texts
)
SELECT query_id, concat_ws(' | ', amount, stamp) AS anomaly_description FROM wrong
WHERE amount IS NOT NULL OR stamp IS NOT NULL
""")
def v1(log):
    texts = text_log(log)
    rules = [
        quality.rule_type(texts, "amount", "int"),
        quality.rule_type(texts, "stamp", "datetime64[ns]"),
    ]
    named = texts.withColumn("arrival_timestamp", F.col("stamp"))
    return quality.anomalies(named, rules).select("query_id", "anomaly_description")


@query("v2_query_type", _one("v2"))
def v2(log):
    return quality.anomalies(log, [quality.rule_query_type()])


@query("v3_missing_read", _one("v3"))
def v3(log):
    return quality.anomalies(log, [quality.rule_missing_read()])


@query("v4_missing_write", _one("v4"))
def v4(log):
    return quality.anomalies(log, [quality.rule_missing_write()])


@query("v5_invalid_read_ids", _one("v5"))
def v5(log):
    return quality.anomalies(log, [quality.rule_invalid_ids("read_table_ids")])


@query("v6_invalid_write_ids", _one("v6"))
def v6(log):
    return quality.anomalies(log, [quality.rule_invalid_ids("write_table_ids")])


@query("v7_negative_exec", _one("v7"))
def v7(log):
    return quality.anomalies(log, [quality.rule_negative_exec()])


@query("v8_instant_uncached", _one("v8"))
def v8(log):
    return quality.anomalies(log, [quality.rule_instant_uncached()])


@query("v9_anomalies", ALL_FOUND + FOUND_ROWS)
def v9(log):
    return quality.anomalies(log)


@query("v10_latest_anomalies", ALL_FOUND + FOUND_ROWS + """
 AND arrival_timestamp > TIMESTAMP '2024-01-15 12:00:00'
ORDER BY arrival_timestamp DESC, query_id DESC LIMIT 10
""")
def v10(log):
    return quality.latest_anomalies(quality.anomalies(log), "2024-01-15 12:00:00")
