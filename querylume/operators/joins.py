"""Joins with a lookup that is unique on its key."""

from pyspark.sql import DataFrame, functions as F

# A key counts as hot when it holds at least one row in HOT_FRACTION. There can be
# at most HOT_FRACTION such keys, however large the data.
HOT_FRACTION = 1000


def join_day_totals(df: DataFrame, totals: DataFrame, how="inner") -> DataFrame:
    """``df`` with its day's totals.

    ``totals`` holds one row per calendar date. Dates run from year 1 to 9999, so it
    has at most 3.65 million short rows: a proven bound for the broadcast.
    """
    keyed = totals.withColumnRenamed("day", "_day")
    return df.join(F.broadcast(keyed), F.col("day") == F.col("_day"), how).drop("_day")


def join_unique(rows: DataFrame, lookup: DataFrame, keys, weight: str, total=None) -> DataFrame:
    """``rows`` inner-joined with ``lookup``, which is unique on ``keys`` and says in
    ``weight`` how many rows each key has (``total`` of them altogether, if known).

    A plain shuffle join would send every row of a hot key to one task. Here the
    rows of hot keys are dealt over several salted copies of their lookup row. The
    hot keys are at most ``HOT_FRACTION`` by arithmetic, so telling the rows which
    keys are hot is a bounded broadcast; the join itself stays a shuffle join unless
    AQE measures the lookup to be small.

    Rows are dealt in the order they come, so as with ``time_slices`` they should come
    from a scan or a checkpoint, which a repeated task reads in the same order.
    """
    keys = list(keys)
    # Null keys join nothing; without them the lookup's branches below are one plan, so
    # that it is computed once.
    lookup, rows = lookup.dropna(subset=keys), rows.dropna(subset=keys)
    total = lookup.agg(F.sum(weight)).scalar() if total is None else total
    per_task = F.greatest(F.floor(total / HOT_FRACTION), F.lit(1))
    copies = F.greatest(F.floor(F.col(weight) / per_task), F.lit(1)).cast("int")
    sized = lookup.withColumn("_copies", copies)
    hot = sized.filter(F.col("_copies") > 1).select(*keys, "_copies")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(
            F.col("_copies").isNotNull(),
            F.pmod(F.monotonically_increasing_id(), F.col("_copies")).cast("int"),
        ).otherwise(0),
    ).drop("_copies")
    salted = sized.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    ).drop("_copies")
    return dealt.join(salted, [*keys, "_salt"]).drop("_salt")
