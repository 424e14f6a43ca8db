"""Casts and null handling. All are built-in expressions."""

from pyspark.sql import Column, functions as F


def to_ts_lenient(col: Column, kind="timestamp") -> Column:
    """Timestamp, or null where the value is not one."""
    return col.try_cast(kind)


def to_ts_strict(col: Column, kind="timestamp") -> Column:
    """Timestamp; a value that is present but not a timestamp fails the job.

    Raises whether or not the session runs in ANSI mode.
    """
    ts = col.try_cast(kind)
    bad = col.isNotNull() & ts.isNull()
    message = F.concat(F.lit("not a timestamp: "), col.cast("string"))
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(ts)


def to_num_lenient(col: Column) -> Column:
    """Double, or null where the value is not a number."""
    return col.try_cast("double")


def to_text(col: Column) -> Column:
    """Text; a null stays null."""
    return col.cast("string")


def unquote(col: Column) -> Column:
    """Text without the quotes that JSON decoding leaves around NaN."""
    return F.btrim(col, F.lit('"'))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def null_to_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def is_whole(col: Column) -> Column:
    return col == F.floor(col)


def to_int_lenient(col: Column, kind="bigint") -> Column:
    """Whole number from text such as ``7``, ``7.0`` or ``NaN``, else null.

    Text that is a plain integer keeps all its digits; only the ``7.0`` form goes
    through double.
    """
    text = unquote(col)
    num = nan_to_null(to_num_lenient(text))
    return F.coalesce(text.try_cast(kind), F.when(is_whole(num), num.try_cast(kind)))
