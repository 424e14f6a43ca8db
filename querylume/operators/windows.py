"""Window operators and gap-free calendars.

Unpartitioned windows appear only over frames with one row per calendar day, never
over log rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def chunk_id(n: int) -> Column:
    """Deals rows into ``n`` chunks without ordering or moving them."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def lag_over(col: str, order_keys, by=()) -> Column:
    """The previous value of ``col`` in the given order."""
    return F.lag(col).over(Window.partitionBy(*by).orderBy(*order_keys))


def rolling_mean(df: DataFrame, order: str, cols, n=7) -> DataFrame:
    """Each column replaced by the mean of its last ``n`` rows (fewer at the start).
    For frames with one row per period."""
    frame = Window.orderBy(order).rowsBetween(1 - n, 0)
    return df.select(order, *[F.avg(c).over(frame).alias(c) for c in cols])


def day_calendar(df: DataFrame, day="day") -> DataFrame:
    """Every date from the first to the last in ``df``."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo IS NOT NULL")
    return span.select(F.explode(F.sequence("lo", "hi")).alias(day))


def fill_days(daily: DataFrame, zeros, day="day") -> DataFrame:
    """``daily`` with a row for every date in its span, ``zeros`` set to 0 in the
    rows added. Both sides have one row per date."""
    return day_calendar(daily, day).join(daily, day, "left").fillna(0, list(zeros))


def fill_hours(hourly: DataFrame, zeros, hour="hour") -> DataFrame:
    """``hourly`` with a row for every hour in its span. Days first and then the hours
    of each day, so no array grows with the span's hours."""
    kind = hourly.schema[hour].dataType
    span = hourly.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).filter("lo IS NOT NULL")
    days = span.select("lo", "hi", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("d"))
    days = days.repartition("d")  # a stray date makes the span long: spread its hours
    midnight = F.col("d").cast(kind)
    each = F.sequence(midnight, midnight + F.expr("INTERVAL 25 HOURS"), F.expr("INTERVAL 1 HOUR"))
    hours = days.select("lo", "hi", "d", F.explode(each).alias(hour))
    # A day has 23 to 25 hours where clocks change.
    own = (F.to_date(hour) == F.col("d")) & F.col(hour).between(F.col("lo"), F.col("hi"))
    return hours.filter(own).select(hour).join(hourly, hour, "left").fillna(0, list(zeros))
