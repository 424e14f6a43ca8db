"""File scans and writes."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from querylume.operators.ordering import sort_log
from querylume.schema import PREVIEW_ROWS


def read_log(spark, *paths, schema=None) -> DataFrame:
    """One or more Parquet files or folders as one frame."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def known_values(df: DataFrame) -> DataFrame:
    """Per column how many rows have a value in it and how many do not, from one scan."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns), F.count("*").alias("_rows"))
    known = counts.unpivot(["_rows"], df.columns, "name", "known")
    return known.select("name", "known", (F.col("_rows") - F.col("known")).alias("missing"))


def preview(df: DataFrame, n=PREVIEW_ROWS) -> DataFrame:
    return df.limit(n)


def count_rows(df: DataFrame) -> int:
    return df.count()


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sorted(df: DataFrame, path: str, ts="arrival_timestamp", n=None) -> None:
    """Parquet part files that hold the log in time order when read by name."""
    sort_log(df, ts, n).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, partition_by=(), path=None) -> None:
    """Create a table from a query, in the warehouse or at ``path``."""
    writer = df.write.mode("errorifexists").format("parquet")
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def cached(df: DataFrame) -> DataFrame:
    """The frame kept for reuse, spilling to disk; call ``unpersist`` when done."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def delete_folder(spark, path: str) -> None:
    """Delete a folder of any store Spark reaches; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def balanced(df: DataFrame, by_day=True) -> DataFrame:
    """Rows spread evenly, by day where there is one."""
    return df.hint("rebalance", *([F.col("day")] if by_day else []))


def write_folders(df: DataFrame, path: str, partition_by) -> None:
    """Write partition folders as the rows lie. Overwrite is per partition folder:
    writing the same rows again replaces them."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_balanced(df: DataFrame, path: str, partition_by) -> None:
    """Write partition folders with files of even size.

    ``rebalance`` groups rows by day where there is one, and AQE then splits days
    that hold more than their share and merges the small ones.
    """
    write_folders(balanced(df, "day" in partition_by), path, partition_by)
