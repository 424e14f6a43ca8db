"""Aggregates and arithmetic used by the reports."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from querylume.functions.casts import nan_to_null


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_if(predicate: Column) -> Column:
    return F.count_if(predicate)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; null, not an error, when ``den`` is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return safe_ratio(num, den) * 100


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, so that averages and sums skip it."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return nan_to_null(F.col(name))
    return F.col(name)


def mean_of(df: DataFrame, name: str) -> Column:
    return F.avg(known(df, name))


def sum_of(df: DataFrame, name: str) -> Column:
    return F.sum(known(df, name))


def log_scale(col: Column) -> Column:
    return F.log1p(col)


def unlog_scale(col: Column) -> Column:
    return F.expm1(col)
