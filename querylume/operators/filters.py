"""Typed filters.

Comparisons put the bare column on one side and a literal of its own type on the
other, so they reach the Parquet scan. Where a table is partitioned by ``day``, a
filter on the timestamp also adds the day bounds it implies, because only those
prune partitions.
"""

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from querylume.functions.casts import nan_to_null
from querylume.functions.times import literal_like, minute_of
from querylume.operators.projections import require_columns

TS = "arrival_timestamp"
TYPE_KEY = "type_key"


def between_ts(df: DataFrame, start=None, end=None, ts=TS) -> DataFrame:
    """Rows from ``start`` to ``end`` as instants: an ``end`` given as a date means
    its midnight, so the rest of that day is outside."""
    if start is not None:
        df = df.filter(F.col(ts) >= literal_like(df, ts, start))
        if "day" in df.columns:
            df = df.filter(F.col("day") >= F.to_date(F.lit(str(start))))
    if end is not None:
        df = df.filter(F.col(ts) <= literal_like(df, ts, end))
        if "day" in df.columns:
            df = df.filter(F.col("day") <= F.to_date(F.lit(str(end))))
    return df


def between_days(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose ``day`` lies in the range, both ends included."""
    if start is not None:
        df = df.filter(F.col("day") >= F.to_date(F.lit(str(start))))
    if end is not None:
        df = df.filter(F.col("day") <= F.to_date(F.lit(str(end))))
    return df


def where_optional(df: DataFrame, query_type=None, user_id=None) -> DataFrame:
    """Equality filters; ``None`` or ``"All"`` adds nothing."""
    if query_type not in (None, "", "All"):
        df = df.filter(F.col("query_type") == query_type)
    if user_id not in (None, "", "All"):
        df = df.filter(F.col("user_id") == int(user_id))
    return df


def latest_day(df: DataFrame, ts=TS, days: DataFrame = None) -> DataFrame:
    """Rows of the last day that has any.

    The day comes from a scalar subquery. On a day-partitioned frame it prunes
    partitions; otherwise it is a range on the timestamp that the Parquet scan
    checks against row-group statistics. ``days`` may name a small frame whose
    ``day`` lists the days there are (such as a store's ``days``), which saves the
    pass over the log that finds the last one.
    """
    if "day" in df.columns:
        newest = (df if days is None else days).agg(F.max("day")).scalar()
        return df.filter(F.col("day") == newest)
    kind = df.schema[ts].dataType
    found = F.to_date(F.max(ts)) if days is None else F.max("day")
    last = (df if days is None else days).agg(found.alias("d"))
    first_instant = last.select(F.col("d").cast(kind)).scalar()
    next_instant = last.select(F.date_add("d", 1).cast(kind)).scalar()
    return df.filter((F.col(ts) >= first_instant) & (F.col(ts) < next_instant))


def minute_multiple(df: DataFrame, n=5, ts=TS) -> DataFrame:
    """Rows that arrived in a minute divisible by ``n``."""
    return df.filter(minute_of(ts) % n == 0)


def present(df: DataFrame, *cols) -> DataFrame:
    """Rows where every column holds a value (neither null nor NaN)."""
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    for c in cols:
        value = nan_to_null(F.col(c)) if c in floating else F.col(c)
        df = df.filter(value.isNotNull())
    return df


def type_key(query_type: Column) -> Column:
    """A query type without its case, as the store keeps it beside the raw spelling."""
    return F.lower(query_type)


def of_type(df: DataFrame, query_type: str) -> DataFrame:
    """Rows of one query type, in whatever case it is asked for and logged.

    A frame of the store has the type without case as a column of its own, and that is
    compared: the scan sees the filter. In other frames the spellings of an ASCII type lie
    between its upper and its lower case, a range that the scan sees, and the rows found
    there are compared without case.
    """
    wanted = query_type.lower()
    if TYPE_KEY in df.columns:
        return df.filter(F.col(TYPE_KEY) == wanted)
    if wanted.isascii():
        df = df.filter(F.col("query_type").between(wanted.upper(), wanted))
    return df.filter(type_key(F.col("query_type")) == wanted)


def col_in(col: Column, values) -> Column:
    return col.isin(*values)


def in_month(df: DataFrame, month: str, ts=TS) -> DataFrame:
    """Rows of a ``yyyy-MM`` month, as a range the scan can prune."""
    first = datetime.date.fromisoformat(f"{month}-01")
    following = (first + datetime.timedelta(days=32)).replace(day=1)
    df = df.filter(
        (F.col(ts) >= literal_like(df, ts, first)) & (F.col(ts) < literal_like(df, ts, following))
    )
    return between_days(df, first, following) if "day" in df.columns else df


def after(df: DataFrame, cursor, ts=TS) -> DataFrame:
    """Rows newer than the last one seen."""
    require_columns(df, [ts])
    df = df.filter(F.col(ts) > literal_like(df, ts, cursor))
    if "day" in df.columns:
        df = df.filter(F.col("day") >= F.to_date(F.lit(str(cursor))))
    return df
