"""Checks on stored logs."""

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

# Ship the functions below with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RUN_COLUMNS = ["path", "first_row", "first", "last", "low", "high", "inversions"]


def _run_schema(kind):
    """One line per stretch of neighbouring rows; ``kind`` is the timestamp type."""
    kinds = [T.StringType(), T.LongType(), kind, kind, kind, kind, T.LongType()]
    return T.StructType([T.StructField(c, k) for c, k in zip(_RUN_COLUMNS, kinds)])


def sort_check(spark, path, ts="arrival_timestamp") -> DataFrame:
    """First and last timestamp of stored files and how many rows come before their
    predecessor, in file order and with files in name order.

    Each scan task walks its rows where they lie and reports one line per stretch of
    neighbouring rows, so no log row is shuffled. Stretches join into longer ones, as
    (first, last, lowest, highest, inversions) of neighbours make those of both: ranges of
    them by file and row first, then FAN neighbouring ranges at a time, as a tree. No task
    orders more than a range of stretches or FAN ranges.
    """
    rows = spark.read.parquet(path)
    schema = _run_schema(rows.schema[ts].dataType)
    runs = rows.select("_metadata.file_path", "_metadata.row_index", ts).mapInArrow(
        _runs_of, schema
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = runs.repartitionByRange(n, "path", "first_row")
    joined = _joined_runs(ranged.withColumn("at", F.spark_partition_id()), "at", ["path", "first_row"])
    while n > 1:
        n = -(-n // FAN)
        joined = _joined_runs(joined.withColumn("of", F.floor(F.col("at") / FAN)), "of", ["at"])
        joined = joined.withColumnRenamed("of", "at")
    return joined.agg(
        F.min("low").alias("first"), F.max("high").alias("last"),
        F.coalesce(F.sum("inversions"), F.lit(0)).alias("out_of_order"),
    )


FAN = 64


def _joined_runs(runs: DataFrame, into: str, order) -> DataFrame:
    """The stretches of each ``into`` joined into one, in their order. A seam between two
    counts when the second begins before the first ends."""
    place = F.struct(*order)
    beside = Window.partitionBy(into).orderBy(*order)
    seam = F.coalesce((F.col("first") < F.lag("last").over(beside)).cast("long"), F.lit(0))
    return runs.withColumn("_seam", seam).groupBy(into).agg(
        F.min_by("first", place).alias("first"), F.max_by("last", place).alias("last"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("inversions") + F.col("_seam")).alias("inversions"),
    )


def _runs_of(batches):
    """One line per stretch of neighbouring rows of a file, across batches.

    Rows with a null timestamp neither are nor cause an inversion, as with ``lag``.
    """
    open_run = None
    for batch in batches:
        stamp = batch.schema.field(2).type
        for run in _runs_in_batch(batch):
            if open_run and run["path"] == open_run["path"] and run["first_row"] == open_run["next"]:
                open_run = _joined(open_run, run)
                continue
            if open_run:
                yield _as_batch(open_run, stamp)
            open_run = run
    if open_run:
        yield _as_batch(open_run, stamp)


def _runs_in_batch(batch):
    """The stretches of one batch, timestamps as whole microseconds."""
    if batch.num_rows == 0:
        return
    path, row, at = batch.column(0), batch.column(1).to_numpy(), batch.column(2).cast(pa.int64())
    files = pc.dictionary_encode(path).indices.to_numpy()
    breaks = ((row[1:] - row[:-1] != 1) | (files[1:] != files[:-1])).nonzero()[0] + 1
    starts = [0, *breaks.tolist()]
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
        part = at.slice(lo, hi - lo)
        span = pc.min_max(part).as_py()
        down = pc.sum(pc.less(part.slice(1), part.slice(0, hi - lo - 1))).as_py()
        yield {
            "path": path[lo].as_py(), "first_row": int(row[lo]),
            "first": part[0].as_py(), "last": part[-1].as_py(),
            "low": span["min"], "high": span["max"],
            "inversions": down or 0, "next": int(row[hi - 1]) + 1,
        }


def _joined(a, b):
    known = a["last"] is not None and b["first"] is not None
    lows = [v for v in (a["low"], b["low"]) if v is not None]
    highs = [v for v in (a["high"], b["high"]) if v is not None]
    return {
        **a, "last": b["last"], "next": b["next"],
        "low": min(lows, default=None), "high": max(highs, default=None),
        "inversions": a["inversions"] + b["inversions"] + int(known and b["first"] < a["last"]),
    }


def _as_batch(run, stamp):
    types = [pa.string(), pa.int64(), stamp, stamp, stamp, stamp, pa.int64()]
    arrays = [
        pa.array([run[c]], pa.int64()).cast(t) if t == stamp else pa.array([run[c]], t)
        for c, t in zip(_RUN_COLUMNS, types)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=_RUN_COLUMNS)
