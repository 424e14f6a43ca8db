"""From raw or textual rows to typed log rows."""

from pyspark.sql import DataFrame, functions as F, types as T

from querylume.functions import casts
from querylume.schema import LOG_SCHEMA


def clean_log(df: DataFrame, ts="arrival_timestamp") -> DataFrame:
    """Rows whose timestamp is present and valid, all columns as they are."""
    if isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df.filter(F.col(ts).isNotNull())
    return df.filter(casts.to_ts_lenient(F.col(ts)).isNotNull())


def conform(df: DataFrame) -> DataFrame:
    """The stream columns in their declared types; extra columns are dropped.

    Values that do not fit become null (the quality rules report them) and NaN
    becomes null. A timestamp column of either kind keeps its type.
    """
    return df.select(*[_conformed(df, field).alias(field.name) for field in LOG_SCHEMA])


def _conformed(df, field):
    have, want = df.schema[field.name].dataType, field.dataType
    col = F.col(field.name)
    if isinstance(want, T.TimestampType):
        return col if isinstance(have, T.TimestampNTZType) else casts.to_ts_lenient(col)
    if isinstance(want, T.StringType):
        return casts.to_text(col)
    if isinstance(want, T.DoubleType):
        col = casts.unquote(col) if isinstance(have, T.StringType) else col
        return casts.nan_to_null(casts.to_num_lenient(col))
    if isinstance(have, T.StringType):
        return casts.to_int_lenient(col, want.simpleString())
    if isinstance(have, (T.DoubleType, T.FloatType)):
        return F.when(casts.is_whole(col), col.try_cast(want.simpleString()))
    return col.try_cast(want.simpleString())
