"""The writes of one micro-batch, each into folders of its own, and its running state."""

import uuid
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from querylume.functions.lists import ids_or_empty
from querylume.functions.numbers import count_rows
from querylume.operators.aggregation import (
    estimate_frequent, frequent_items_sketch, merge_sketches,
)
from querylume.operators.explode import explode_accesses
from querylume.operators.filters import TYPE_KEY, type_key
from querylume.operators.projections import with_day
from querylume.sources.files import balanced
from querylume.streaming.commits import Part
from querylume.streaming.slots import read_slot, write_slot
from querylume.streaming.store import WITHOUT_DAY, LogStore


def part_name(kind: str) -> str:
    """A name no other writer, and no other try of this one, uses."""
    return f"{kind}-{uuid.uuid4().hex}"


def _days_written(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return [n.removeprefix("day=") for n in names if n.startswith("day=")]


def write_part(df: DataFrame, store: LogStore, part: Part) -> list:
    """Write rows as a new part, a folder per day, and return the parts to commit. Nobody
    reads them before that."""
    spark = df.sparkSession
    by = [] if part.table in WITHOUT_DAY else ["day"]
    folder = f"{store.path(part.table)}/part={part.name}"
    df.write.mode("errorifexists").partitionBy(*by).parquet(folder)
    if not by:
        return [part]
    return [replace(part, day=day) for day in _days_written(spark, folder)]


def batch_part(table: str, batch_id: int, name: str, state="done") -> Part:
    return Part(table, name, level=0, first=batch_id, last=batch_id, state=state)


def tagged(df, batch_id):
    return df.withColumn("batch_id", F.lit(batch_id).cast("long"))


def append_log(df: DataFrame, batch_id: int, store: LogStore, name: str, table="main") -> list:
    """Rows (balanced already, with their ``day``) into their day's folder, made on
    demand. Late rows land in their own day. The main table has the type without its case
    beside the raw one, for filters that reach the scan."""
    main = table == "main"
    rows = df.withColumn(TYPE_KEY, type_key(F.col("query_type"))) if main else df
    return write_part(tagged(rows, batch_id), store, batch_part(table, batch_id, name, "new" if main else "done"))


def append_anomalies(found: DataFrame, batch_id: int, store: LogStore, name: str) -> list:
    """Anomalies into their day's folder; one with a bad timestamp has a null day."""
    rows = balanced(tagged(with_day(found), batch_id))
    return write_part(rows, store, batch_part("anomalies", batch_id, name))


def append_rejected(rejected: DataFrame, batch_id: int, store: LogStore, name: str) -> list:
    rows = balanced(tagged(rejected, batch_id), by_day=False)
    return write_part(rows, store, batch_part("rejected", batch_id, name))


def add_days(df: DataFrame, batch_id: int, store: LogStore) -> None:
    """Add this batch's rows and table accesses to the running counts per day."""
    accesses = F.size(ids_or_empty(F.col("read_table_ids"))) + F.size(
        ids_or_empty(F.col("write_table_ids"))
    )
    mine = with_day(df).groupBy("day").agg(
        count_rows().alias("rows"), F.sum(accesses).cast("long").alias("table_accesses"),
        F.lit(batch_id).cast("long").alias("last_batch"),
    )
    known = store.days(df.sparkSession, before=batch_id)
    total = known.unionByName(mine).groupBy("day").agg(
        F.sum("rows").alias("rows"), F.sum("table_accesses").alias("table_accesses"),
        F.max("last_batch").alias("last_batch"),
    )
    write_slot(total, store.path("days"), batch_id)


def add_sketch(df: DataFrame, batch_id: int, store: LogStore, capacity: int) -> None:
    """Merge this batch's frequent tables into the running sketch."""
    mine = frequent_items_sketch(explode_accesses(df, []), "table_id", capacity)
    known = read_slot(df.sparkSession, store.path("sketch"), mine.schema, before=batch_id)
    merged = merge_sketches(known.unionByName(mine), capacity)
    write_slot(merged, store.path("sketch"), batch_id)


def top_tables_approx(df: DataFrame, k=10, capacity=10_000) -> DataFrame:
    """Most accessed tables by sketch: one small state per task, no shuffle of ids.
    Exact while there are fewer tables than ``capacity`` can track."""
    sketch = frequent_items_sketch(explode_accesses(df, []), "table_id", capacity)
    return estimate_frequent(sketch, k)


def top_tables_seen(spark, store: LogStore, k=10) -> DataFrame:
    """Most accessed tables over everything ingested, from the running sketch."""
    try:
        versions = spark.read.option("ignoreMissingFiles", "true").parquet(store.path("sketch"))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], "table_id string, count long")
    versions = versions.filter(F.col("batch_id") <= store.live(spark).batch)
    newest = versions.agg(F.max("batch_id")).scalar()
    return estimate_frequent(versions.filter(F.col("batch_id") == newest), k)
