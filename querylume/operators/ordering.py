"""Sorts, limits, top-k and sampling."""

from pyspark.sql import DataFrame, functions as F


TS = "arrival_timestamp"
SPREAD_SEED = 17


def order(df: DataFrame, *keys) -> DataFrame:
    """Total order. Use on results; ``sort_log`` is for whole logs."""
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, col: str, k=None, tie_keys=()) -> DataFrame:
    """Largest ``k`` rows by ``col`` (all, sorted, for ``None``); ``tie_keys`` make
    the choice among equals repeatable."""
    ranked = df.orderBy(F.desc(col), *tie_keys)
    return ranked if k is None else ranked.limit(k)


def recent(df: DataFrame, n: int, cols, ts=TS) -> DataFrame:
    """The ``n`` newest rows, by time and then by id."""
    return df.orderBy(F.desc(ts), F.desc("query_id")).limit(n).select(*cols)


def time_slices(df: DataFrame, ts=TS, n=None) -> DataFrame:
    """Rows range-partitioned by time and sorted inside each partition.

    The range key goes on after the timestamp, to the query id and a seeded spread
    value, so a burst of rows with one timestamp, or of copies of one row, is cut
    over several partitions. Partitions stay in time order. With ``n`` unset AQE
    sizes them by bytes.

    The spread follows the order of the input, so a task that is repeated must see
    its rows in the same order again. A scan does that; checkpoint a frame that comes
    out of a shuffle first.
    """
    keys = [F.col(ts), *([F.col("query_id")] if "query_id" in df.columns else [])]
    by = [*keys, F.rand(SPREAD_SEED)]
    ranged = df.repartitionByRange(*by) if n is None else df.repartitionByRange(n, *by)
    return ranged.sortWithinPartitions(*keys, _row_hash(df))


def _row_hash(df):
    return F.xxhash64(*[F.col(c) for c in df.columns])


def sort_log(df: DataFrame, ts=TS, n=None) -> DataFrame:
    """A log in time order: one range shuffle, then a spilling sort per partition.
    Written out, its part files in name order hold the log in time order."""
    return time_slices(df, ts, n)


DRAW_BITS = 60


def sample_n(df: DataFrame, n: int, seed: int, key="query_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same for the same seed.

    Takes the rows with the ``n`` smallest draws: the MD5 of key and seed, equal ones by
    the columns in their order. Only rows below a threshold a little above the expected
    ``n``-th draw are sorted, some ``n`` of them on a big log. The threshold comes from
    the row count as a scalar subquery, so building the plan runs nothing. All other rows
    take part only if those below it are fewer than ``n``, which the plan settles by
    another scalar subquery; the result is the same.
    """
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    draw = F.md5(text.cast("binary"))
    high = F.conv(F.substring(draw, 1, DRAW_BITS // 4), 16, 10).cast("long")
    drawn = df.withColumns({"_draw": draw, "_high": high})
    wanted = n + 10 * n**0.5 + 100
    total = df.agg(F.count("*").alias("total"))
    ceiling = total.select(F.when(
        F.col("total") > wanted, F.lit(2.0**DRAW_BITS) * wanted / F.col("total")
    ).otherwise(2.0**DRAW_BITS)).scalar()
    below = drawn.filter(F.col("_high") < ceiling)
    short = below.agg(F.count("*") < n).scalar()
    rest = drawn.filter((F.col("_high") >= ceiling) & short)
    return below.unionByName(rest).orderBy("_draw", *df.columns).limit(n).drop("_draw", "_high")
