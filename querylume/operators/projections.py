"""Column-level operators: subset, rename, relabel, unpivot, day key."""

from pyspark.sql import Column, DataFrame, functions as F

from querylume.functions.times import day_of
from querylume.schema import RAW_ONLY_COLUMNS


def drop_raw_only(df: DataFrame) -> DataFrame:
    """Without the columns that only the raw file has; absent ones are no error."""
    return df.drop(*RAW_ONLY_COLUMNS)


def require_columns(df: DataFrame, cols) -> DataFrame:
    """The frame itself, or ``ValueError`` naming the columns it lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def project(df: DataFrame, cols) -> DataFrame:
    return require_columns(df, cols).select(*cols)


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def relabel(col: Column, mapping: dict) -> Column:
    """Text of the value, with the values in ``mapping`` replaced by their label."""
    text = col.cast("string")
    labelled = F.lit(None).cast("string")
    for value, label in mapping.items():
        labelled = F.when(text == str(value), F.lit(label)).otherwise(labelled)
    return F.coalesce(labelled, text)


def unpivot(df: DataFrame, ids, values, var="variable", val="value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def with_day(df: DataFrame, ts="arrival_timestamp") -> DataFrame:
    """With the date partition key; a frame that has one keeps it."""
    return df if "day" in df.columns else df.withColumn("day", day_of(ts))


def distinct_on(df: DataFrame, cols) -> DataFrame:
    """Distinct combinations of ``cols``."""
    return df.select(*cols).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
