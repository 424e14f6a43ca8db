"""Exact numbers of distinct queries of any days, from state that merges.

Distinct counts do not add up, but the sets behind them do. The state holds, per day, query
type and table (null: the type as a whole), the query ids in buckets of 32,768 neighbouring
ids: the few of a sparse bucket as a list of places, those of a fuller one as a bitmap. A
report over a range of days merges the buckets and counts; it reads no log row.
"""

from pyspark.sql import DataFrame, functions as F

from querylume.functions.numbers import percent
from querylume.operators.explode import explode_read_write
from querylume.operators.filters import between_days
from querylume.operators.ordering import top_k

KEYS = ["day", "query_type", "table_id"]
# A bucket of more ids than this is a bitmap of 4 kB; a list of as many is about as long.
FEW = 1024


def query_sets(rows: DataFrame) -> DataFrame:
    """The state of some log rows (with their ``day``): KEYS, bucket, few and bits. A query
    uses a table if it has both a read and a write list that name it in either; rows without
    an id count nowhere."""
    types = rows.select("day", "query_type", F.lit(None).cast("string").alias("table_id"), "query_id")
    uses = explode_read_write(rows, keep=("day", "query_type", "query_id"), once=True)
    used = types.unionByName(uses.select(types.columns)).filter(F.col("query_id").isNotNull())
    places = used.select(
        *KEYS, F.expr("bitmap_bucket_number(query_id)").alias("bucket"),
        F.expr("bitmap_bit_position(query_id)").cast("int").alias("place"))
    lists = places.groupBy(*KEYS, "bucket").agg(F.collect_set("place").alias("few"))
    sparse = F.size("few") <= FEW
    by = [*KEYS, "bucket"]
    return _together(lists.filter(sparse), _bitmaps(lists.filter(~sparse), by), by)


def _together(lists, bitmaps, by):
    return lists.select(*by, "few", F.lit(None).cast("binary").alias("bits")).unionByName(
        bitmaps.select(*by, F.lit(None).cast("array<int>").alias("few"), "bits"))


def _bitmaps(lists, by):
    """The places of ``few`` as bits."""
    return lists.select(*by, F.explode("few").alias("place")).groupBy(*by).agg(
        F.expr("bitmap_construct_agg(place)").alias("bits"))


def merged(sets: DataFrame, keys) -> DataFrame:
    """Sets of one of ``keys`` and bucket as one: few (places) or bits. A bucket holds 32,768
    ids at most, so a group's lists are bounded by the number of sets times FEW. Bitmaps take
    a way of their own: beside the lists each group would carry 4 kB, most of them empty."""
    by = [*keys, "bucket"]
    lists = sets.groupBy(*by).agg(
        F.array_distinct(F.flatten(F.collect_list("few"))).alias("few"),
        F.max(F.col("bits").isNotNull()).alias("full"))
    sparse = ~F.col("full") & (F.size("few") <= FEW)
    full = sets.filter(F.col("bits").isNotNull()).select(*by, "bits")
    bitmaps = full.unionByName(_bitmaps(lists.filter(~sparse), by)).groupBy(*by).agg(
        F.expr("bitmap_or_agg(bits)").alias("bits"))
    return _together(lists.filter(sparse), bitmaps, by)


def distinct_counts(sets: DataFrame, keys) -> DataFrame:
    """Distinct queries per ``keys``, as ``count``."""
    n = F.when(F.col("bits").isNull(), F.size("few")).otherwise(F.expr("bitmap_count(bits)"))
    counted = merged(sets, list(keys)).groupBy(*keys).agg(F.sum(n.cast("long")).alias("count"))
    return counted


def _shares(sets, key, start, end, k):
    days = between_days(sets, start, end)
    whole = days.filter("table_id IS NULL")
    asked = whole if key == "query_type" else days.filter("table_id IS NOT NULL")
    total = distinct_counts(whole, []).select("count").scalar()
    shares = distinct_counts(asked, [key]).withColumn("overall_percentage", percent(F.col("count"), total))
    return shares if k is None else top_k(shares, "count", k, tie_keys=[key])


def type_share(sets: DataFrame, start=None, end=None, k=None) -> DataFrame:
    """Distinct queries by type in a range of days, as a share of all its queries."""
    return _shares(sets, "query_type", start, end, k)


def table_share(sets: DataFrame, start=None, end=None, k=None) -> DataFrame:
    """Tables by the share of the range's distinct queries that use them."""
    return _shares(sets, "table_id", start, end, k)
