"""Retention: only the last days of the main table and its summaries count.

The newest day is the last one that a clock at most ``DAYS_AHEAD`` days ahead can have
given. Rows dated later are kept and never make others expire.
"""

import datetime

from pyspark.sql import DataFrame, functions as F

from querylume.plans.views import SUMMARIES
from querylume.schema import DAYS_KEPT
from querylume.streaming.store import DAYS_AHEAD, LogStore, summary_table, trusted


def retained(df: DataFrame, days=DAYS_KEPT, newest: DataFrame = None,
             ahead=DAYS_AHEAD) -> DataFrame:
    """Rows of the last ``days`` days up to the newest one, and of days in the future.

    ``newest`` is a frame whose ``day`` names the days seen (the rows themselves by
    default; a store's ``days`` is cheaper, since it opens no data file). The bound is a
    scalar subquery on the partition column, so expired folders are not read.
    """
    seen = df if newest is None else newest
    bound = seen.filter(trusted("day", ahead)).agg(F.date_sub(F.max("day"), days)).scalar()
    # Without a trusted day nothing is expired.
    return df.filter(F.col("day") > F.coalesce(bound, F.lit("0001-01-01").cast("date")))


def retained_main(spark, store: LogStore, days=DAYS_KEPT) -> DataFrame:
    return retained(store.read(spark, "main"), days, store.days(spark))


def retained_summary(spark, store: LogStore, name: str, days=DAYS_KEPT) -> DataFrame:
    """A summary over the retained days only, its shares included."""
    counts = retained(store.stored_counts(spark, name), days, store.days(spark))
    return SUMMARIES[name][1](counts)


def _expired(have, days, ahead=DAYS_AHEAD):
    """Of some dates those that lie ``days`` or more before the newest trusted one."""
    limit = datetime.date.today() + datetime.timedelta(days=ahead)
    newest = max((d for d in have if d <= limit), default=None)
    if newest is None:
        return []
    return sorted(d for d in have if d <= newest - datetime.timedelta(days=days))


def expired_days(spark, table: str, days=DAYS_KEPT) -> list:
    """Days of a partitioned table that lie ``days`` or more before its newest one.
    Reads the partition list only."""
    listed = spark.sql(f"SHOW PARTITIONS {table}")
    found = listed.select(
        F.regexp_extract("partition", r"(?:^|/)day=(\d{4}-\d{2}-\d{2})(?:/|$)", 1).alias("day")
    ).filter("day <> ''").distinct()
    return _expired([datetime.date.fromisoformat(r["day"]) for r in found.collect()], days)


def apply_retention(spark, table: str, days=DAYS_KEPT) -> list:
    """Drop the expired days of a partitioned table; returns them."""
    gone = expired_days(spark, table, days)
    for day in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = DATE'{day}')")
    return gone


def expired_in_store(spark, store: LogStore, days=DAYS_KEPT, before=None) -> list:
    """The expired days among all days ever stored (one row per calendar day)."""
    return _expired([r["day"] for r in store.days(spark, before).select("day").collect()], days)


# What retention takes from a store; the archive, anomalies and live numbers stay.
EXPIRING = ("main", "ids", "distinct", *map(summary_table, SUMMARIES))


def parts_of_days(live, days) -> list:
    """The parts of some days that retention removes."""
    return [p for table in EXPIRING for p in live.of(table, days, gone=True)]


def expire(spark, store: LogStore, days=DAYS_KEPT) -> list:
    """Remove the expired days from the main table and the summaries, never from the
    archive; returns them. One commit: readers see a day whole or not at all. Removing a
    day again is no error, so a batch may be replayed."""
    gone = expired_in_store(spark, store, days)
    if gone:
        def change(live):
            parts = parts_of_days(live, gone)
            return ([], parts, None) if parts else None
        store.commit(spark, change)
    return gone
