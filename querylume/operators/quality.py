"""Data-quality rules: each is one expression, null when the row is fine.

The rules look at two things: a column as it came, and the number or time it reads
as. The readings are columns of their own (``_num_<name>``, ``_ts_<name>``) that
``anomalies`` derives once, in a projection below the rules. Casting inside every
rule instead costs several times as much, in repeated work and in generated code too
long to be compiled.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from querylume.functions import casts
from querylume.functions.lists import common_ids, join_texts
from querylume.operators.filters import after, col_in
from querylume.operators.ordering import top_k
from querylume.schema import (
    EXPECTED_TYPES, INVALID_TABLE_IDS, LEGAL_QUERY_TYPES, READING_TYPES, WRITING_TYPES,
)

# The texts of the rules below and what joins them.
SEPARATOR = " | "


def _number(name):
    return F.col(f"_num_{name}")


def _time(name):
    return F.col(f"_ts_{name}")


def with_readings(df: DataFrame) -> DataFrame:
    """With the number and time each column reads as, null where it does not. The
    readings no rule asks for are pruned."""
    readings = []
    for f in df.schema:
        col, kind = F.col(f.name), f.dataType
        if isinstance(kind, T.StringType):
            readings.append(casts.to_num_lenient(casts.unquote(col)).alias(f"_num_{f.name}"))
            readings.append(casts.to_ts_lenient(col).alias(f"_ts_{f.name}"))
        elif isinstance(kind, T.NumericType):
            readings.append(col.cast("double").alias(f"_num_{f.name}"))
        else:
            readings.append(col.alias(f"_ts_{f.name}"))
    return df.select("*", *readings)


def rule_type(df: DataFrame, name: str, expected: str) -> Column:
    """A value that is present but does not fit its declared type.

    Text is judged by what it reads as. Of a typed column only a fraction where a
    whole number is declared is left to find.
    """
    def found(what):
        return F.lit(f"{name} expected {expected}, found {what}")

    kind = df.schema[name].dataType
    is_text = isinstance(kind, T.StringType)
    if expected == "datetime64[ns]" and is_text:
        return F.when(F.col(name).isNotNull() & _time(name).isNull(), found("text"))
    if expected not in ("int", "float"):
        return F.lit(None).cast("string")
    unread = F.when(F.col(name).isNotNull() & _number(name).isNull(), found("text"))
    if expected == "float" or not isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)):
        return unread if is_text else F.lit(None).cast("string")
    fraction = F.when(
        ~F.isnan(_number(name)) & ~casts.is_whole(_number(name)), found("float")
    )
    return F.coalesce(unread, fraction) if is_text else fraction


def rule_query_type() -> Column:
    shown = F.coalesce(F.col("query_type"), F.lit("None"))
    return F.when(
        ~col_in(shown, LEGAL_QUERY_TYPES), F.concat(F.lit("Invalid query_type `"), shown, F.lit("`"))
    )


def _rule_missing(name, types):
    absent = casts.null_to_empty(F.col(name)) == ""
    return F.when(
        col_in(F.col("query_type"), types) & absent,
        F.concat(F.lit(f"Missing {name} for `"), F.col("query_type"), F.lit("` query")),
    )


def rule_missing_read() -> Column:
    return _rule_missing("read_table_ids", READING_TYPES)


def rule_missing_write() -> Column:
    return _rule_missing("write_table_ids", WRITING_TYPES)


def rule_invalid_ids(name: str) -> Column:
    hits = common_ids(F.col(name), INVALID_TABLE_IDS)
    shown = F.concat(F.lit("{'"), F.array_join(hits, "', '"), F.lit("'}"))
    return F.when(
        F.size(hits) > 0, F.concat(F.lit(f"{name} contains invalid values "), shown)
    )


def rule_negative_exec() -> Column:
    took = _number("execution_duration_ms")
    return F.when(
        took < 0,
        F.concat(F.lit("execution_duration_ms is negative ("), took.cast("string"), F.lit(")")),
    )


def rule_instant_uncached() -> Column:
    instant = _number("execution_duration_ms") == 0
    uncached = ~_number("was_cached").eqNullSafe(F.lit(1.0))
    return F.when(instant & uncached, F.lit("Query executed instantly but was not cached"))


def default_rules(df: DataFrame) -> list:
    """All rules in the order their messages are reported."""
    typed = [rule_type(df, c, t) for c, t in EXPECTED_TYPES.items() if c in df.columns]
    return typed + [
        rule_query_type(),
        rule_missing_read(),
        rule_missing_write(),
        rule_invalid_ids("read_table_ids"),
        rule_invalid_ids("write_table_ids"),
        rule_negative_exec(),
        rule_instant_uncached(),
    ]


def anomalies(df: DataFrame, rules=None) -> DataFrame:
    """One row per offending log row, its messages joined in rule order.

    One pass without a shuffle, however many rules there are. Rows without a message
    are left out by exploding an empty array rather than by a filter: a filter would
    be pushed below the projections that derive the columns, and derive each column
    again for every rule that reads it.
    """
    rules = default_rules(df) if rules is None else rules
    id_is_text = isinstance(df.schema["query_id"].dataType, T.StringType)
    query_id = casts.to_int_lenient(F.col("query_id")) if id_is_text else F.col("query_id")
    found = F.array_remove(F.array(join_texts(rules, SEPARATOR)), "")
    return with_readings(df).select(
        _time("arrival_timestamp").alias("arrival_timestamp"), query_id.alias("query_id"),
        F.explode(found).alias("anomaly_description"),
    )


def latest_anomalies(found: DataFrame, cursor, n=10) -> DataFrame:
    """The newest ``n`` anomalies after ``cursor``."""
    return top_k(after(found, cursor), "arrival_timestamp", n, tie_keys=[F.desc("query_id")])


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > 1)
    )
