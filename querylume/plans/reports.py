"""The dashboard queries."""

from pyspark.sql import DataFrame, functions as F

from querylume.functions.numbers import (
    count_if, count_rows, mean_of, percent, safe_ratio, sum_of,
)
from querylume.functions.times import floor_to, format_time
from querylume.operators.aggregation import (
    distinct_queries, distinct_query_counts, share_of_total, value_counts,
)
from querylume.operators.explode import explode_ids, explode_read_write
from querylume.operators.filters import (
    between_days, between_ts, in_month, latest_day, minute_multiple, present, where_optional,
)
from querylume.operators.ordering import top_k
from querylume.operators.projections import relabel, rename, require_columns, unpivot, with_day
from querylume.operators.windows import fill_days, fill_hours, rolling_mean

TS = "arrival_timestamp"
# The output column names of the reports below.


# -- trends -------------------------------------------------------------------


def cached_counts(df: DataFrame) -> DataFrame:
    """Queries by ``was_cached``."""
    return value_counts(df, "was_cached")


def hourly_durations(df: DataFrame) -> DataFrame:
    """Mean compile and execution time per hour."""
    require_columns(df, [TS, "compile_duration_ms", "execution_duration_ms"])
    return present(df, TS).groupBy(floor_to(df, TS, "hour").alias("hour")).agg(
        mean_of(df, "compile_duration_ms").alias("compile_duration_ms"),
        mean_of(df, "execution_duration_ms").alias("execution_duration_ms"),
    )


def exec_by_type_cached(df: DataFrame) -> DataFrame:
    """Mean execution time by query type and whether it was cached."""
    means = present(df, "query_type", "was_cached").groupBy("query_type", "was_cached").agg(
        mean_of(df, "execution_duration_ms").alias("avg_execution_time_ms")
    )
    # Chart labels.
    labels = {"0": "Not Cached", "1": "Cached"}
    return means.withColumn("was_cached", relabel(F.col("was_cached"), labels))


def joins_scans_by_type(df: DataFrame) -> DataFrame:
    """Mean number of joins and scans by query type, one row per metric."""
    means = present(df, "query_type").groupBy("query_type").agg(
        mean_of(df, "num_joins").alias("avg_joins"),
        mean_of(df, "num_scans").alias("avg_scans"),
    )
    return unpivot(means, ["query_type"], ["avg_joins", "avg_scans"], "Metric", "Average Count")


# -- headline numbers ---------------------------------------------------------


def headline(df: DataFrame) -> DataFrame:
    """Total queries, hit rate in percent, mean compile time and latest date, in one
    pass over the log."""
    return df.agg(
        count_rows().alias("total_queries"),
        percent(F.sum("was_cached"), count_rows()).alias("cache_hit_rate"),
        mean_of(df, "compile_duration_ms").alias("avg_compile_time"),
        F.to_date(F.max(TS)).alias("latest_query_date"),
    )


def headline_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Headline numbers and the most frequent query type of a time range.

    Grouped by type first, so the mode needs no table of all types in one task.
    """
    compile_ms = "compile_duration_ms"
    rows = between_ts(df, start, end)
    by_type = rows.groupBy("query_type").agg(
        count_rows().alias("n"),
        F.sum("was_cached").alias("hits"),
        sum_of(df, compile_ms).alias("spent"),
        F.count(F.when(F.col(compile_ms).isNotNull() & ~F.isnan(compile_ms), 1)).alias("timed"),
    )
    rank = F.when(
        F.col("query_type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("query_type"))
    )
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"),
        percent(F.sum("hits"), F.sum("n")).alias("cache_hit_rate"),
        safe_ratio(F.sum("spent"), F.sum("timed")).alias("avg_compile_time"),
        F.min_by("query_type", rank).alias("most_frequent_query"),
    )


# -- latest day ---------------------------------------------------------------


def fifth_minute_hit_rate(df: DataFrame, days=None) -> DataFrame:
    """Hit rate of each minute divisible by five, on the latest day. ``days`` as in
    ``latest_day``, here and below."""
    rows = minute_multiple(latest_day(df, days=days), 5)
    return rows.groupBy(floor_to(df, TS, "minute").alias("minute")).agg(
        percent(count_if(F.col("was_cached") == 1), count_rows())
        .alias("total_hit_rate_per_5_minutes")
    )


def latest_type_share(df: DataFrame, k=8, days=None) -> DataFrame:
    """Distinct queries by type on the latest day, as a share of all its queries."""
    today = latest_day(df, days=days)
    shares = distinct_query_counts(today, "query_type").withColumn(
        "overall_percentage", percent(F.col("count"), distinct_queries(today))
    )
    return top_k(shares, "count", k, tie_keys=["query_type"])


def latest_table_share(df: DataFrame, k=None, include_one_sided=False, days=None) -> DataFrame:
    """Tables used on the latest day by share of its distinct queries.

    By default a query counts only if it has both a read and a write list.
    """
    today = latest_day(df, days=days)
    uses = explode_read_write(today, include_one_sided, once=True)
    shares = distinct_query_counts(uses, "table_id").withColumn(
        "overall_percentage", percent(F.col("count"), distinct_queries(today))
    )
    return shares if k is None else top_k(shares, "count", k, tie_keys=["table_id"])


# -- reports over the maintained summaries --------------------------------------


def _top_of_summary(rows, key, share, k):
    grouped = rows.groupBy(key).agg(F.sum("count").alias("count"), F.sum(share).alias(share))
    shares = share_of_total(grouped, "count", out="overall_percentage")
    return top_k(shares, "count", k, tie_keys=[key])


def top_tables(m1: DataFrame, start=None, end=None, query_type=None, user_id=None, k=10):
    """Most accessed tables of a day range; shares are of the filtered accesses."""
    rows = where_optional(between_days(m1, start, end), query_type, user_id)
    return _top_of_summary(rows, "table_id", "percentage", k)


def top_types(m3: DataFrame, start=None, end=None, user_id=None, k=5):
    """Most frequent query types of a day range."""
    rows = where_optional(between_days(m3, start, end), user_id=user_id)
    return _top_of_summary(rows, "query_type", "daily_percentage", k)


def hit_rate_range(m4: DataFrame, start=None, end=None, query_type=None, user_id=None):
    """Hit rate per day from the maintained summary."""
    rows = where_optional(between_days(m4, start, end), query_type, user_id)
    return rows.groupBy("day").agg(F.sum("hit_rate_per_day").alias("cache_hit_rate"))


# -- most used tables from the reads --------------------------------------------

# Column headings of the two table charts.
TABLE_HEADINGS = {"table_id": "Table ID", "count": "Query Count", "share": "Percentage"}


def top_tables_by_reads(df: DataFrame, k=10) -> DataFrame:
    """Tables by number of reads, as a share of all reads."""
    counts = value_counts(explode_ids(df, "read_table_ids", keep=[]), "table_id")
    ranked = top_k(share_of_total(counts, "count"), "count", k, tie_keys=["table_id"])
    return rename(ranked, TABLE_HEADINGS)


def top_tables_by_queries(df: DataFrame, k=10) -> DataFrame:
    """Tables by number of distinct queries that read them, as a share of all
    distinct queries."""
    reads = explode_ids(df, "read_table_ids", keep=["query_id"])
    counts = distinct_query_counts(reads, "table_id")
    shares = counts.withColumn("share", percent(F.col("count"), distinct_queries(df)))
    return rename(top_k(shares, "count", k, tie_keys=["table_id"]), TABLE_HEADINGS)


# -- over time ------------------------------------------------------------------


def hourly_counts(df: DataFrame) -> DataFrame:
    """Queries per hour; an hour without any counts 0."""
    hourly = present(df, TS).groupBy(floor_to(df, TS, "hour").alias(TS)).agg(
        F.count("query_id").alias("query_id")
    )
    return fill_hours(hourly, ["query_id"], TS)


def type_counts(df: DataFrame) -> DataFrame:
    return rename(
        value_counts(df, "query_type"), {"query_type": "Query Type", "count": "Count"}
    )


def _per_day(df, **aggregates):
    rows = present(with_day(df), "day")
    daily = rows.groupBy("day").agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return fill_days(daily, list(aggregates))


def rolling_scan_spill(df: DataFrame, days=7) -> DataFrame:
    """Megabytes scanned and spilled per day, as a rolling mean over ``days``."""
    cols = ["mbytes_scanned", "mbytes_spilled"]
    daily = _per_day(df, **{c: F.coalesce(sum_of(df, c), F.lit(0.0)) for c in cols})
    return rename(rolling_mean(daily, "day", cols, days), {"day": TS})


def daily_hit_rate(df: DataFrame) -> DataFrame:
    """Hits, queries and hit rate per day; a day without queries has no rate."""
    daily = _per_day(
        df,
        was_cached=F.coalesce(F.sum("was_cached"), F.lit(0)),
        query_id=F.count("query_id"),
    )
    rated = daily.withColumn("cache_hit_rate", percent(F.col("was_cached"), F.col("query_id")))
    return rename(rated, {"day": TS})


def rows_per_day(df: DataFrame, month: str) -> DataFrame:
    """Rows per day of a ``yyyy-MM`` month."""
    rows = in_month(df, month)
    return rows.groupBy(format_time(F.col(TS), "yyyy-MM-dd").alias("day")).agg(
        count_rows().alias("record_count")
    )


