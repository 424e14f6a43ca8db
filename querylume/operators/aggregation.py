"""Grouped counts, shares of a total and frequent items."""

from pyspark.sql import DataFrame, functions as F

from querylume.functions.numbers import count_rows, percent


def value_counts(df: DataFrame, col: str, out="count") -> DataFrame:
    """Rows per value; nulls are not a value."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(count_rows().alias(out))


def share_of_total(df: DataFrame, col: str, by=(), out="share") -> DataFrame:
    """``col`` as a percentage of its total, overall or within ``by``.

    The overall total is a scalar subquery: no window that would pull all rows into
    one task. Totals within ``by`` come from a pre-aggregated join, which AQE turns
    into a broadcast when they turn out small and splits when a key is hot.
    """
    if not by:
        total = df.agg(F.sum(col)).scalar()
        return df.withColumn(out, percent(F.col(col), total))
    by = list(by)
    renamed = {c: f"_total_{c}" for c in by}
    totals = (
        df.groupBy(*by).agg(F.sum(col).alias("_total")).withColumnsRenamed(renamed)
    )
    same = [df[c].eqNullSafe(totals[t]) for c, t in renamed.items()]
    joined = df.join(totals, same, "left")
    return joined.withColumn(out, percent(F.col(col), F.col("_total"))).drop(
        "_total", *renamed.values()
    )


def mode_smallest(df: DataFrame, by, col: str) -> DataFrame:
    """Most frequent value of ``col`` for each value of ``by``, the smallest on ties; null
    only where there is no other. Grouped by both first, so no task keeps a counter per
    value."""
    by = [by] if isinstance(by, str) else list(by)
    counted = df.groupBy(*by, col).agg(count_rows().alias("_n"))
    best = F.struct(F.col(col).isNull(), -F.col("_n"), F.col(col))
    return counted.groupBy(*by).agg(F.min_by(col, best).alias(col))


def distinct_query_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct queries per value of ``col``.

    Deduplicates on (value, query) first, so a hot value is spread over many tasks,
    and only then counts per value.
    """
    return (
        df.select(col, "query_id").distinct()
        .groupBy(col).agg(F.count("query_id").alias("count"))
    )


def distinct_queries(df: DataFrame):
    """The number of distinct queries as a scalar subquery."""
    return df.agg(F.count_distinct("query_id")).scalar()


# -- frequent items by sketch -------------------------------------------------


def merge_sketches(sketches: DataFrame, capacity: int) -> DataFrame:
    """All sketches as one; no row if there are none. Grouped by a constant, because
    the combine function does not take the empty input of an ungrouped aggregate."""
    merged = F.expr(f"approx_top_k_combine(sketch, {int(capacity)})").alias("sketch")
    return sketches.groupBy(F.lit(0).alias("_all")).agg(merged).select("sketch")


def frequent_items_sketch(df: DataFrame, col: str, capacity: int, slices=64) -> DataFrame:
    """A mergeable frequent-items sketch of ``col``, as one row.

    Built per slice of the input partitions first, so that on a big cluster the last
    task merges ``slices`` sketches and not one from every task.
    """
    made = F.expr(f"approx_top_k_accumulate({col}, {int(capacity)})").alias("sketch")
    sliced = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(slices)).alias("_slice")).agg(made)
    return merge_sketches(sliced, capacity)


def estimate_frequent(sketch: DataFrame, k: int, out="table_id") -> DataFrame:
    """The ``k`` most frequent items of a sketch with their counts."""
    items = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(k)})")).alias("i"))
    return items.select(F.col("i.item").alias(out), F.col("i.count").alias("count"))
