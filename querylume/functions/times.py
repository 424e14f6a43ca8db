"""Time helpers that keep the timestamp type of their input column."""

from pyspark.sql import Column, DataFrame, functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def floor_to(df: DataFrame, name: str, unit: str) -> Column:
    """``date_trunc`` in the type of the column (with or without zone)."""
    return F.date_trunc(unit, F.col(name)).cast(df.schema[name].dataType)


def day_of(name: str) -> Column:
    return F.to_date(F.col(name))


def minute_of(name: str) -> Column:
    return F.minute(F.col(name))


def format_time(col: Column, pattern: str) -> Column:
    return F.date_format(col, pattern)


def shift_days(col: Column, days: int) -> Column:
    return F.date_add(col, days) if days >= 0 else F.date_sub(col, -days)


def iso_text(col: Column) -> Column:
    return F.date_format(col, ISO_FORMAT)


def literal_like(df: DataFrame, name: str, value) -> Column:
    """``value`` as a literal of the column's own type, so that a comparison with
    the column needs no cast on the column side and reaches the scan."""
    return F.lit(str(value)).cast(df.schema[name].dataType)
