"""The maintained summaries.

Each summary comes in two steps: ``*_counts`` reduces log rows to additive counts
per day, and ``*_shares`` turns counts into the percentages a reader sees. Only the
counts are stored (see ``refresh``), since every overall percentage changes
whenever a day arrives.

Day totals are joined back as one row per date. A window over ``day`` would give the
same numbers but pull all groups of a day into one task. From a log they come from a
second, narrow scan that needs no shuffle of log rows: grouping the counts again
would cost as much as grouping them the first time when most groups are small.
From stored counts they are summed up.
"""

from pyspark.sql import DataFrame, Window, functions as F

from querylume.functions.lists import ids_or_empty
from querylume.functions.numbers import count_if, count_rows, known, percent, safe_ratio
from querylume.operators.explode import explode_accesses, explode_ids
from querylume.operators.filters import between_ts, of_type, present
from querylume.operators.joins import join_day_totals, join_unique
from querylume.operators.projections import with_day


# The output column names of the summaries below.


def _day_totals(rows: DataFrame, amount) -> DataFrame:
    return with_day(rows).groupBy("day").agg(F.sum(amount).alias("total"))


def _with_shares(groups: DataFrame, totals: DataFrame, day_share: str) -> DataFrame:
    # One row per calendar date, so the window over all of them is small; the totals and
    # their sum reach the groups in one broadcast.
    overall = F.sum("total").over(Window.partitionBy(F.lit(0)))
    lookup = totals.withColumn("overall", overall).withColumnRenamed("day", "_day")
    # Groups without a day are part of the whole, but have no share of a day.
    day_total = F.when(F.col("day").isNotNull(), F.col("total"))
    return (
        groups.join(F.broadcast(lookup), F.col("day").eqNullSafe(F.col("_day")), "left")
        .withColumn(day_share, percent(F.col("count"), day_total))
        .withColumn("overall_percentage", percent(F.col("count"), F.col("overall")))
        .drop("total", "overall", "_day")
    )


# -- table accesses -----------------------------------------------------------


def table_access_counts(df: DataFrame) -> DataFrame:
    keys = ["day", "query_type", "user_id"]
    accesses = explode_accesses(with_day(df), keys)
    return accesses.groupBy("day", "table_id", "query_type", "user_id").agg(
        count_rows().alias("count")
    )


def _access_totals(df):
    reads, writes = ids_or_empty(F.col("read_table_ids")), ids_or_empty(F.col("write_table_ids"))
    return _day_totals(df, F.size(reads) + F.size(writes))


def table_access_shares(counts: DataFrame, totals: DataFrame = None) -> DataFrame:
    totals = _day_totals(counts, F.col("count")) if totals is None else totals
    return _with_shares(counts, totals, "percentage").select(
        "day", "table_id", "query_type", "user_id", "count", "percentage", "overall_percentage"
    )


def table_access_daily(df: DataFrame) -> DataFrame:
    """Accesses per day, table, query type and user, with their share of the day's
    accesses and of all accesses."""
    return table_access_shares(table_access_counts(df), _access_totals(df))


def table_access_rows(df: DataFrame) -> DataFrame:
    """One row per access, with the count and shares of its (day, table).

    The result is as long as the log; it is not sorted as a whole.
    """
    accesses = explode_accesses(with_day(df), ["arrival_timestamp", "day"])
    counts = accesses.groupBy("day", "table_id").agg(count_rows().alias("count"))
    # The totals come from the counts: they are grouped once and reused.
    shares = _with_shares(counts, _day_totals(counts, F.col("count")), "percentage")
    return join_unique(accesses, shares, ["day", "table_id"], "count").select(
        "arrival_timestamp", "day", "table_id", "count", "percentage", "overall_percentage"
    )


# -- query types --------------------------------------------------------------


def query_type_counts(df: DataFrame) -> DataFrame:
    """Counted by the text of the type first; only the few texts are split into types."""
    texts = with_day(df).groupBy("day", "query_type", "user_id").agg(count_rows().alias("n"))
    each = explode_ids(texts, "query_type", "query_type", keep=["day", "user_id", "n"])
    return each.groupBy("day", "query_type", "user_id").agg(F.sum("n").alias("count"))


def query_type_shares(counts: DataFrame, totals: DataFrame = None) -> DataFrame:
    totals = _day_totals(counts, F.col("count")) if totals is None else totals
    return _with_shares(counts, totals, "daily_percentage").select(
        "day", "query_type", "user_id", "count", "daily_percentage", "overall_percentage"
    )


def query_types_daily(df: DataFrame) -> DataFrame:
    """Queries per day, type and user, with their share of the day and of all."""
    totals = _day_totals(df, F.size(ids_or_empty(F.col("query_type"))))
    return query_type_shares(query_type_counts(df), totals)


# -- cache hits ---------------------------------------------------------------


def hit_counts(df: DataFrame) -> DataFrame:
    return with_day(df).groupBy("day", "query_type", "user_id").agg(
        count_if(F.col("was_cached") == 1).alias("was_cached_count"),
        count_rows().alias("total_count"),
    )


def hit_rates(counts: DataFrame, totals: DataFrame = None) -> DataFrame:
    totals = _day_totals(counts, F.col("total_count")) if totals is None else totals
    named = totals.withColumnRenamed("total", "total_queries")
    return join_day_totals(counts, named).select(
        "day", "query_type", "user_id", "was_cached_count", "total_queries",
        percent(F.col("was_cached_count"), F.col("total_queries")).alias("hit_rate_per_day"),
    )


def hit_rate_daily(df: DataFrame) -> DataFrame:
    """Cache hits per day, type and user over the whole day's queries.

    The rates of a day add up to the day's hit rate; under a filter their sum is
    the filtered groups' contribution to it, not a rate of its own.
    """
    return hit_rates(hit_counts(df), _day_totals(df, F.lit(1)))


# -- compile time by number of joins ------------------------------------------


def compile_counts(df: DataFrame) -> DataFrame:
    """Sum and number of known compile times per day and join count, selects only."""
    spent = known(df, "compile_duration_ms")
    return (
        present(of_type(with_day(df), "select"), "num_joins")
        .groupBy("day", "num_joins")
        .agg(F.sum(spent).alias("compile_sum"), F.count(spent).alias("compile_count"),
             count_rows().alias("total_count"))
    )


def compile_means(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("num_joins").alias("x")).agg(
        safe_ratio(F.sum("compile_sum"), F.sum("compile_count")).alias("y")
    )


def compile_by_joins(df: DataFrame, start=None, end=None) -> DataFrame:
    """Mean compile time (``y``) by number of joins (``x``), selects only."""
    selects = present(of_type(between_ts(df, start, end), "select"), "num_joins")
    return selects.groupBy(F.col("num_joins").alias("x")).agg(
        F.avg(known(df, "compile_duration_ms")).alias("y")
    )


# name -> (log rows to stored counts, stored counts to what a reader sees)
SUMMARIES = {
    "table_access": (table_access_counts, table_access_shares),
    "query_types": (query_type_counts, query_type_shares),
    "hit_rate": (hit_counts, hit_rates),
    "compile_by_joins": (compile_counts, compile_means),
}
# The additive columns of the stored counts. The last one of each counts rows, so a group
# whose rows were all taken off again has 0 there.
AMOUNTS = {
    "table_access": ["count"],
    "query_types": ["count"],
    "hit_rate": ["was_cached_count", "total_count"],
    "compile_by_joins": ["compile_sum", "compile_count", "total_count"],
}
