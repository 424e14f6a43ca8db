"""Small state tables that are rewritten every micro-batch.

Batch ``n`` reads what the batch before it left and writes the whole new state into
slot ``n % SLOTS``. The table therefore never holds more than ``SLOTS`` versions, a
replayed batch starts from the same predecessor and replaces its own slot, and the
newest version is never the one being written.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from querylume.sources.files import write_balanced

SLOTS = 16


def write_slot(df: DataFrame, path: str, batch_id: int) -> None:
    tagged = df.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn(
        "slot", F.lit(batch_id % SLOTS)
    )
    write_balanced(tagged, path, ["slot"])


_TAGS = [T.StructField("batch_id", T.LongType()), T.StructField("slot", T.IntegerType())]


def read_slot(spark, path: str, schema: T.StructType, before=None) -> DataFrame:
    """The newest version (of a batch earlier than ``before``), empty if none.

    A dashboard may read while the oldest slot is being replaced, so files that
    vanish meanwhile are not an error.
    """
    try:
        versions = (
            spark.read.option("ignoreMissingFiles", "true")
            .schema(T.StructType(schema.fields + _TAGS)).parquet(path)
        )
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        versions = versions.filter(F.col("batch_id") < before)
    newest = versions.agg(F.max("batch_id")).scalar()
    return versions.filter(F.col("batch_id") == newest).drop("batch_id", "slot")
