"""Messages: JSON arrays of log rows, or one JSON object per row.

A source is a dict with ``format`` and its options, such as
``{"format": "kafka", "kafka.bootstrap.servers": ..., "subscribe": ...}`` or
``{"format": "parquet", "path": ...}`` for files with one message per row.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from querylume.functions.times import ISO_FORMAT
from querylume.operators.ordering import time_slices
from querylume.operators.projections import drop_raw_only
from querylume.schema import ROWS_PER_MESSAGE, TEXT_SCHEMA

VALUE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])
JSON_OPTIONS = {
    "timestampFormat": ISO_FORMAT,
    "timestampNTZFormat": ISO_FORMAT,
    "ignoreNullFields": "false",
}
# monotonically_increasing_id holds the row's place in its partition in the lower
# 33 bits, as documented.
_PLACE_BITS = (1 << 33) - 1
# A message is long: the 4096 rows that a Parquet reader takes at a time would be near a GB
# of text. It takes no more than a row group has, so these are small (compressed bytes).
ROW_GROUP_BYTES = 1 << 20


# -- encoding -------------------------------------------------------------------


def to_batches(df: DataFrame, n=ROWS_PER_MESSAGE, ts="arrival_timestamp", slices=None) -> DataFrame:
    """Messages of up to ``n`` rows each, in time order within and between messages.

    Rows are range-partitioned by time and numbered where they lie, so no task sees
    more than its slice and no group holds more than ``n`` rows. The last message
    of a slice may be shorter. Rows go into their message as the JSON text they will be.
    """
    rows = drop_raw_only(df)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS))
    placed = time_slices(rows, ts, slices).select(
        F.spark_partition_id().alias("slice"),
        place.alias("place"),
        F.to_json(F.struct(*rows.columns), JSON_OPTIONS).alias("row"),
    )
    grouped = placed.groupBy("slice", F.floor(F.col("place") / n).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("place", "row"))).alias("items")
    )
    array = F.concat(F.lit("["), F.array_join("items.row", ","), F.lit("]"))
    return grouped.select("slice", "chunk", array.alias("value"))


def to_messages(df: DataFrame, n=None) -> DataFrame:
    """One JSON object per row, for all rows or the first ``n``."""
    rows = df if n is None else df.limit(n)
    return rows.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("value"))


def write_messages(messages: DataFrame, sink: dict) -> None:
    """Append messages to Kafka, or to files in a folder."""
    options = {k: v for k, v in sink.items() if k != "format"}
    out = messages.select("value")
    if sink["format"] == "kafka":
        out = out.select(F.encode("value", "UTF-8").alias("value"))
    if sink["format"] == "parquet":
        options = {"parquet.block.size": str(ROW_GROUP_BYTES), **options}
    out.write.format(sink["format"]).options(**options).mode("append").save()


# -- decoding -------------------------------------------------------------------


def message_stream(spark, source: dict, max_messages=None, max_files=None) -> DataFrame:
    """Messages as text, from the earliest one on.

    One micro-batch takes at most ``max_messages`` messages of Kafka (each of up to 800
    rows), or ``max_files`` files of a file source. Where the query resumes is up to its
    checkpoint.
    """
    options = {k: v for k, v in source.items() if k != "format"}
    reader = spark.readStream.format(source["format"])
    if source["format"] == "kafka":
        if max_files:
            raise ValueError("Kafka is limited by messages, not by files")
        options = {"startingOffsets": "earliest", **options}
        if max_messages:
            options["maxOffsetsPerTrigger"] = str(max_messages)
        return reader.options(**options).load().select(F.col("value").cast("string"))
    if max_messages:
        raise ValueError("a file source is limited by files, not by messages")
    if max_files:
        options["maxFilesPerTrigger"] = str(max_files)
    return reader.schema(VALUE_SCHEMA).options(**options).load()


def read_messages(spark, source: dict) -> DataFrame:
    """The raw text of all messages there are now, as a batch."""
    options = {k: v for k, v in source.items() if k != "format"}
    reader = spark.read.format(source["format"])
    if source["format"] == "kafka":
        options = {"startingOffsets": "earliest", "endingOffsets": "latest", **options}
        return reader.options(**options).load().select(F.col("value").cast("string"))
    return reader.schema(VALUE_SCHEMA).options(**options).load()


def parsed(messages: DataFrame) -> DataFrame:
    """The rows of each message, or its text in ``value`` when it cannot be read
    (``rows`` is null then)."""
    decoded = messages.select("value", F.from_json("value", T.ArrayType(TEXT_SCHEMA)).alias("rows"))
    return decoded.select(F.when(F.col("rows").isNull(), F.col("value")).alias("value"), "rows")


def rows_of(decoded: DataFrame) -> DataFrame:
    """One row per log row of the readable messages, values still text."""
    return decoded.select(F.inline("rows"))


def rejected_of(decoded: DataFrame) -> DataFrame:
    """The messages that cannot be read."""
    return decoded.filter(F.col("rows").isNull()).select("value")


def split_rejected(messages: DataFrame):
    """``(rows, rejected)`` of a batch or stream of messages."""
    decoded = parsed(messages)
    return rows_of(decoded), rejected_of(decoded)


def read_batches(spark, source: dict, **limits) -> DataFrame:
    """A stream of log rows from JSON-array messages, values still text."""
    return rows_of(parsed(message_stream(spark, source, **limits)))
