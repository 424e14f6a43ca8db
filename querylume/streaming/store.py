"""Where the ingest keeps its tables, and how they are read back.

All tables are Parquet folders below one root, which belongs to one streaming checkpoint.
Which folders count is said by the log of commits (see ``commits``): a micro-batch writes
folders of its own and switches them in together, in all tables at once, in place of those
an earlier try of the same batch left. Small running state is kept in slots (see ``slots``).
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from querylume.operators.filters import TYPE_KEY
from querylume.plans.views import AMOUNTS, SUMMARIES
from querylume.schema import ANOMALY_SCHEMA, LOG_SCHEMA
from querylume.streaming import commits
from querylume.streaming.slots import read_slot

_BATCH = [T.StructField("batch_id", T.LongType())]
_DAY = [T.StructField("day", T.DateType())]
_PART = [T.StructField("part", T.StringType())]
BUCKETS = T.StructType().add("bucket", "timestamp").add("hits", "long").add("queries", "long")

# Columns as stored; the day, where there is one, is that of the folder.
_LOG = T.StructType(LOG_SCHEMA.fields + _BATCH)
_STORED = {
    "main": T.StructType(LOG_SCHEMA.fields + [T.StructField(TYPE_KEY, T.StringType())] + _BATCH),
    "archive": _LOG,
    "anomalies": T.StructType(ANOMALY_SCHEMA.fields + _BATCH),
    "rejected": T.StructType(
        [T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())] + _BATCH
    ),
    "ids": T.StructType().add("block", "integer").add("bits", "binary"),
    "live/hit_rate": BUCKETS,
    "distinct": T.StructType().add("query_type", "string").add("table_id", "string").add("bucket", "long")
    .add("few", T.ArrayType(T.IntegerType())).add("bits", "binary"),
}
WITHOUT_DAY = {"rejected"}
# One row per day seen: its rows, its table accesses, the last batch that added some.
DAYS_SCHEMA = T.StructType(
    _DAY + [T.StructField(c, T.LongType()) for c in ("rows", "table_accesses", "last_batch")]
)
# A clock may be ahead by this many days. A day further in the future is stored like any
# other, but it is not the newest day: one wrong clock must not make all others old.
DAYS_AHEAD = 1


def trusted(day, ahead=DAYS_AHEAD):
    """Whether a day lies no further than ``ahead`` after the date of processing."""
    return F.col(day) <= F.date_add(F.current_date(), ahead)


def summary_table(name):
    return f"summaries/{name}"


@dataclass(frozen=True)
class LogStore:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # -- the parts that count ---------------------------------------------------------

    def live(self, spark) -> commits.Live:
        return commits.read_live(spark, self.path("_commits"))

    def commit(self, spark, change) -> commits.Live:
        return commits.commit(spark, self.path("_commits"), change)

    def read_parts(self, spark, table: str, parts, with_part=False) -> DataFrame:
        """The rows of some parts of a table; only their folders are listed."""
        return self._read(spark, table, [p.folder for p in parts], with_part)

    def read_written(self, spark, table: str, name: str, parts) -> DataFrame:
        """The rows a writer has just put into ``parts``, all days of ``name``, by the one
        folder they share; committed or not."""
        return self._read(spark, table, [f"{table}/part={name}"] if parts else [], False)

    def _read(self, spark, table, folders, with_part):
        schema = self._schema(spark, table)
        day = [] if table in WITHOUT_DAY else _DAY
        if not folders:
            empty = spark.createDataFrame([], T.StructType(schema.fields + _PART + day))
            return empty if with_part else empty.drop("part")
        found = (
            spark.read.schema(T.StructType(schema.fields + _PART + day))
            .option("basePath", self.path(table))
            .parquet(*(f"{self.root}/{folder}" for folder in folders))
        )
        return found if with_part else found.drop("part")

    @staticmethod
    def _schema(spark, table):
        if table in _STORED:
            return _STORED[table]
        counts = SUMMARIES[table.removeprefix("summaries/")][0]
        made = counts(spark.createDataFrame([], T.StructType(_LOG.fields + _DAY))).schema
        return T.StructType([f for f in made.fields if f.name != "day"])

    def read(self, spark, table: str) -> DataFrame:
        """A table of the store; empty, with its schema, before the first write."""
        return self.read_parts(spark, table, self.live(spark).of(table))

    def read_days(self, spark, table: str, days) -> DataFrame:
        """Some days of a table, listing no other day's folders. Days that are not there,
        or were removed by retention, have no rows."""
        return self.read_parts(spark, table, self.live(spark).of(table, days))

    # -- days and summaries -----------------------------------------------------------

    def days(self, spark, before=None) -> DataFrame:
        """What was ingested per day, as of the newest committed batch (or before ``before``)."""
        before = self.live(spark).batch + 1 if before is None else before
        return read_slot(spark, self.path("days"), DAYS_SCHEMA, before)

    def trusted_days(self, spark, before=None, ahead=DAYS_AHEAD) -> DataFrame:
        """The days that may be the newest: none further in the future than ``ahead``."""
        return self.days(spark, before).filter(trusted("day", ahead))

    def days_in_the_future(self, spark, ahead=DAYS_AHEAD) -> DataFrame:
        """The days stored with rows of a clock that is too far ahead."""
        return self.days(spark).filter(~trusted("day", ahead))

    def newest_day(self, spark, before=None):
        """The newest trusted day as a date, None before the first one."""
        return self.trusted_days(spark, before).agg(F.max("day").alias("d")).first()["d"]

    def stored_counts(self, spark, name: str) -> DataFrame:
        """The additive counts of a summary, as last refreshed; empty before that."""
        return self.read(spark, summary_table(name))

    def summary(self, spark, name: str) -> DataFrame:
        """A summary as a reader sees it, percentages computed over what is stored."""
        return SUMMARIES[name][1](self.stored_counts(spark, name))

    def distinct(self, spark) -> DataFrame:
        """The sets of distinct queries (see ``plans.distinct``), as last refreshed."""
        return self.read(spark, "distinct")

    def register(self, spark) -> None:
        """Temp views over the store, for reports written as SQL text: ``query_log``,
        ``anomalies`` and one view per summary."""
        self.read(spark, "main").drop("batch_id").createOrReplaceTempView("query_log")
        self.read(spark, "anomalies").drop("batch_id").createOrReplaceTempView("anomalies")
        for name in SUMMARIES:
            self.summary(spark, name).createOrReplaceTempView(name)


def added_up(counts: DataFrame, name: str) -> DataFrame:
    """Counts of a summary with one row per group, groups that came to nothing left out."""
    amounts = AMOUNTS[name]
    keys = [c for c in counts.columns if c not in amounts]
    total = counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in amounts))
    return total.filter(F.col(amounts[-1]) != 0)


def running_total(spark, store: LogStore) -> DataFrame:
    """Elements seen so far, by key."""
    totals = store.days(spark).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("table_accesses"), F.lit(0)).alias("total_tables"),
    )
    return totals.unpivot([], ["total_rows", "total_tables"], "key", "total_elements_seen")
