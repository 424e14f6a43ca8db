"""Filters of the query ids that are stored, so that few stored ids have to be read.

A Bloom filter per day and part of the main table. It is cut into blocks of 32,768 bits,
one row each, made and asked by Spark's bitmap functions: an id has PROBES bits in one
block, which the low bits of its hash name.
"""

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 15
BITS_PER_ID, PROBES = 16, 8


def blocks_for(n: int) -> int:
    """Blocks of a filter for ``n`` ids: a power of two."""
    return 1 << max(0, (-(-n * BITS_PER_ID // BITS) - 1).bit_length())


def _block(blocks):
    return F.xxhash64("query_id").bitwiseAND(F.col(blocks) - 1).cast("int")


def _probes():
    """The bits of an id in its block: steps of an odd width from some place."""
    place = F.xxhash64("query_id", F.lit(1)).bitwiseAND(F.lit(BITS - 1))
    step = F.xxhash64("query_id", F.lit(2)).bitwiseAND(F.lit(BITS - 1)).bitwiseOR(F.lit(1))
    return [(place + i * step) % BITS for i in range(PROBES)]


def day_blocks(spark, ids_per_day: dict) -> DataFrame:
    """Day and blocks of its filter; one row per calendar day."""
    rows = [(day, blocks_for(n)) for day, n in ids_per_day.items()]
    return spark.createDataFrame(rows, "day date, blocks long")


def filters(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Filters (day, block, bits) of the ids in ``rows`` (day, query_id). ``blocks`` has a
    row per calendar day, a proven bound for the broadcast."""
    known = rows.select("day", "query_id").filter(F.col("query_id").isNotNull())
    sized = known.join(F.broadcast(blocks), "day")
    bits = sized.select("day", _block("blocks").alias("block"), F.explode(F.array(*_probes())).alias("bit"))
    return bits.groupBy("day", "block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def suspects(rows: DataFrame, heads: DataFrame, stored: DataFrame) -> DataFrame:
    """day, query_id and part of the ids in ``rows`` (day, query_id) that a filter may hold.

    ``heads`` (day, part, blocks) lists the filters of these days, which the store's list of
    parts has on the driver already; ``stored`` holds their blocks (day, part, block, bits).
    """
    known = rows.select("day", "query_id").filter(F.col("query_id").isNotNull())
    asked = known.join(F.broadcast(heads), "day").withColumn("block", _block("blocks"))
    met = asked.join(stored, ["day", "part", "block"])
    byte = lambda p: F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = [byte(p).bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) != 0 for p in _probes()]
    every = held[0]
    for one in held[1:]:
        every = every & one
    return met.filter(every).select("day", "query_id", "part")
