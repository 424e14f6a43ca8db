"""Live dashboard numbers, kept by the ingest beside its tables.

Numbers that add up are kept as sums: those of the headline one row per day, rewritten
per batch (see ``slots``); those of the hit rate one row per five-minute bucket and
batch, in folders by day, so a batch writes the buckets it has rows for and no others, and
merging (see ``merging``) adds them up.
Late rows count whenever they come. Shares of distinct queries do not add up; they are
counted from the stored rows of the latest day alone, whose folder is all that is read.

The latest day is the newest one the store trusts (see ``store.DAYS_AHEAD``).
"""

from pyspark.sql import DataFrame, functions as F, types as T

from querylume.functions.numbers import count_if, count_rows, known, percent, safe_ratio
from querylume.operators.aggregation import distinct_queries, distinct_query_counts
from querylume.operators.explode import explode_read_write
from querylume.sources.files import balanced
from querylume.streaming.sinks import batch_part, write_part
from querylume.streaming.slots import read_slot, write_slot
from querylume.streaming.store import LogStore, trusted

TS = "arrival_timestamp"
EVERY = "5 minutes"
HEADLINE = (
    T.StructType().add("day", "date").add("total_queries", "long").add("hits", "long")
    .add("compile_sum", "double").add("compile_count", "long")
)


def add_live(rows: DataFrame, batch_id: int, store: LogStore, name: str) -> list:
    """Add a batch of typed rows (with their ``day``) to the live numbers; returns the parts
    to commit. A replay starts from the same predecessor and replaces what the batch wrote."""
    spark = rows.sparkSession
    spent = known(rows, "compile_duration_ms")
    mine = rows.groupBy("day").agg(
        count_rows().alias("total_queries"),
        F.coalesce(F.sum("was_cached"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(spent), F.lit(0.0)).alias("compile_sum"),
        F.count(spent).alias("compile_count"),
    )
    path = store.path("live/headline")
    before = read_slot(spark, path, HEADLINE, before=batch_id)
    sums = [F.sum(c).alias(c) for c in HEADLINE.names[1:]]
    write_slot(before.unionByName(mine).groupBy("day").agg(*sums), path, batch_id)

    window = F.window(F.col(TS).cast("timestamp"), EVERY)["start"]
    buckets = rows.groupBy("day", window.alias("bucket")).agg(
        count_if(F.col("was_cached") == 1).alias("hits"), count_rows().alias("queries")
    )
    return write_part(balanced(buckets), store, batch_part("live/hit_rate", batch_id, name))


def headline_now(spark, store: LogStore) -> DataFrame:
    """The headline numbers over all days so far."""
    days = read_slot(spark, store.path("live/headline"), HEADLINE, store.live(spark).batch + 1)
    return days.agg(
        F.coalesce(F.sum("total_queries"), F.lit(0)).alias("total_queries"),
        percent(F.sum("hits"), F.sum("total_queries")).alias("cache_hit_rate"),
        safe_ratio(F.sum("compile_sum"), F.sum("compile_count")).alias("avg_compile_time"),
        F.max(F.when(trusted("day"), F.col("day"))).alias("latest_query_date"),
    )


def hit_rate_now(spark, store: LogStore, days=None) -> DataFrame:
    """Hit rate per bucket, of some days or all; of days, only their folders are read."""
    if days is None:
        buckets = store.read(spark, "live/hit_rate")
    else:
        buckets = store.read_days(spark, "live/hit_rate", days)
    return buckets.groupBy("bucket").agg(
        percent(F.sum("hits"), F.sum("queries")).alias("hit_rate"))


def _latest_rows(spark, store):
    day = store.newest_day(spark)
    if day is None:
        return store.read(spark, "main")
    return store.read_days(spark, "main", [day])


def _shares(counts, rows):
    return counts.withColumn(
        "overall_percentage", percent(F.col("count"), distinct_queries(rows)))


def type_share_now(spark, store: LogStore) -> DataFrame:
    """Query types of the latest day, as a share of its queries."""
    rows = _latest_rows(spark, store)
    return _shares(distinct_query_counts(rows, "query_type"), rows)


def table_share_now(spark, store: LogStore) -> DataFrame:
    """Tables of the latest day, as a share of its queries."""
    rows = _latest_rows(spark, store)
    uses = explode_read_write(rows, once=True)
    return _shares(distinct_query_counts(uses, "table_id"), rows)
