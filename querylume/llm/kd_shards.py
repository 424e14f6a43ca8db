"""Shards of near-equal bytes by K-d tree partitioning, with DataFrame functions alone.

The space has one dimension for each piece of metadata. A node that is to become k shards
is cut at the weighted median of its widest dimension (at the k/2 share for odd k), until
every leaf is one shard. A median is found by histograms: a pass counts bytes in bins of
the range it may lie in, and the bin that holds it is the next range. One row per node
leaves a pass, whatever the data.
"""

from pyspark.sql import DataFrame, Window, functions as F

from querylume.llm.common import dropped, written

N_SHARDS = 24
ROW_BYTES = 8
# A group of equal texts is cut only if it holds more than this share of a shard.
GROUP_SHARE = 1 / 16
BINS = 4096
# A median is near enough when its bin holds less than this share of a shard.
NEAR = 1 / 1024
VALUE_BITS, TIE_BITS = 20, 40
SLOT_ROWS = 50_000


def _metadata(docs: DataFrame) -> DataFrame:
    """What is held of each row, with its ``number``: a hash of where the row was written,
    so that rows of one id, or of none, are told apart too. It is written with the rows, and
    read from there ever after."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), "lang", "source",
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("number"),
    )


def _unit_bytes(total, n_shards):
    return max(1, int(total / n_shards * GROUP_SHARE))


def _with_pieces(rows: DataFrame, unit: int) -> DataFrame:
    """Rows with the piece of their group they belong to: 0, but for the groups of equal
    texts above ``unit`` bytes. Those are fewer than the shards divided by GROUP_SHARE,
    however many rows there are, and so may be broadcast."""
    heavy = (
        rows.groupBy("digest").agg(F.sum("size").alias("held")).filter(F.col("held") > unit)
        .select("digest", F.ceil(F.col("held") / unit).alias("pieces"))
    )
    piece = F.pmod("number", F.coalesce("pieces", F.lit(1).cast("long")))
    return rows.join(F.broadcast(heavy), "digest", "left").withColumn("piece", piece).drop("pieces")


def _dimensions():
    """Each as a whole number of VALUE_BITS; texts and names spread by their hash."""
    top = 1 << VALUE_BITS
    return [
        F.least(F.lit(top - 1), (F.log2(F.col("size").cast("double")) * (top / 64)).cast("long")),
        F.shiftright("text_crc32", 32 - VALUE_BITS),
        F.pmod(F.xxhash64("lang"), F.lit(top)),
        F.pmod(F.xxhash64("source"), F.lit(top)),
    ]


def _units(rows: DataFrame) -> DataFrame:
    """What a shard takes whole: a group of equal texts or a piece of one, with its bytes
    and a code per dimension, whose low bits break ties by the text."""
    units = rows.groupBy("digest", "piece").agg(
        F.sum("size").alias("bytes"), F.min("size").alias("size"),
        F.min("text_crc32").alias("text_crc32"), F.min("lang").alias("lang"),
        F.min("source").alias("source"),
    )
    tie = F.pmod(F.xxhash64("digest", "piece"), F.lit(1 << TIE_BITS))
    codes = [
        (F.shiftleft(value.cast("long"), TIE_BITS) + tie).alias(f"code{i}")
        for i, value in enumerate(_dimensions())
    ]
    return units.select("digest", "piece", "bytes", *codes, F.lit(0).alias("node"))


def _by_node(values):
    """The value of each row's node; nodes are numbered from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("node") + 1)


def _medians(units, wanted, dims, low, high, near):
    """For each node the code where the bytes below it come nearest to ``wanted`` (None
    for a node that is not cut). The ranges shrink to one bin a pass."""
    n = len(wanted)
    below, cut = [0] * n, [None] * n
    open_ = [i for i in range(n) if wanted[i] is not None]
    low, high = list(low), list(high)
    while open_:
        steps = [max(1, -(-(high[i] - low[i] + 1) // BINS)) for i in range(n)]
        code = F.element_at(F.array("code0", "code1", "code2", "code3"), _by_node(dims) + 1)
        inside = units.filter(F.col("node").isin(open_)).select(
            "node", "bytes", code.alias("code"), _by_node(low).alias("low"),
            _by_node(high).alias("high"), _by_node(steps).alias("step"),
            _by_node([float(w or 0) - b for w, b in zip(wanted, below)]).alias("left"),
        ).filter("code BETWEEN low AND high")
        bins = inside.groupBy("node", "left", F.expr("(code - low) div step").alias("bin")).agg(
            F.sum("bytes").alias("bytes"))
        # At most BINS rows a node.
        so_far = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        reached = (
            bins.withColumn("so_far", so_far)
            .groupBy("node").agg(
                F.min_by(F.struct("bin", "bytes", "so_far"),
                         F.when(F.col("so_far") >= F.col("left"), F.col("bin"))).alias("at"),
                F.max(F.struct("bin", "bytes", "so_far")).alias("last"))
            .select("node", F.coalesce("at", "last").alias("at")).collect()
        )
        for row in reached:
            i, at = row["node"], row["at"]
            first = low[i] + at["bin"] * steps[i]
            after = first + steps[i]
            if at["bytes"] <= near or steps[i] == 1:
                over = below[i] + at["so_far"] - wanted[i]
                cut[i] = after if over <= at["bytes"] / 2 else first
                open_.remove(i)
            else:
                below[i] += at["so_far"] - at["bytes"]
                low[i], high[i] = first, min(high[i], after - 1)
    return cut


def _split(units: DataFrame, shares, total_shares):
    """One level of the tree: ``shares`` has how many shards each node is to become."""
    names = [f"code{i}" for i in range(4)]
    stats = {
        r["node"]: r for r in units.groupBy("node").agg(
            F.sum("bytes").alias("bytes"),
            *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max))).collect()
    }
    total = sum(r["bytes"] for r in stats.values())
    ranges = [[(r[f"min_{c}"], r[f"max_{c}"]) for c in names] if r else [(0, 0)] * 4
              for r in map(stats.get, range(len(shares)))]
    whole = [max(1, max(r[c][1] for r in ranges) - min(r[c][0] for r in ranges)) for c in range(4)]
    dims = [max(range(4), key=lambda c: ((r[c][1] - r[c][0]) / whole[c], -c)) for r in ranges]
    wanted = [
        stats[i]["bytes"] * (k // 2) / k if k > 1 and i in stats else None
        for i, k in enumerate(shares)
    ]
    low, high = ([r[d][side] for r, d in zip(ranges, dims)] for side in (0, 1))
    cut = _medians(units, wanted, dims, low, high, total / total_shares * NEAR)
    new_shares, left, right = [], [], []
    for k in shares:
        left.append(len(new_shares))
        new_shares.append(k // 2 if k > 1 else k)
        right.append(len(new_shares) if k > 1 else left[-1])
        if k > 1:
            new_shares.append(k - k // 2)
    code = F.element_at(F.array(*names), _by_node(dims) + 1)
    below = code < _by_node([0 if c is None else c for c in cut])
    return units.withColumn("node", F.when(below, _by_node(left)).otherwise(_by_node(right))), new_shares


def kd_shards(docs: DataFrame, n_shards=N_SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law (``bytes``), shard, slot and
    grown_shard (null: this law does not add shards) of every row of ``docs`` (doc_id,
    text, lang, source; more columns are ignored).

    Shard sizes are near equal: apart from the rounding of a cut to a whole unit. Equal
    texts share a shard unless they hold more than GROUP_SHARE of one; then they are dealt
    by a number that is written with each row, so that rows that repeat a doc_id, or have
    none, are dealt like any others. Null texts are empty, null metadata is a value of its
    own. Slots run from 0 in each shard, in no order of the documents. With fewer units than
    shards some are empty; no rows, no rows.
    """
    spark = docs.sparkSession
    held = written(_metadata(docs), "shard-rows")
    sums = held.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    rows = _with_pieces(held, _unit_bytes(sums["bytes"] or 0, n_shards))
    units, shares = written(_units(rows), "shard-units"), [n_shards]
    while max(shares) > 1:
        split, shares = _split(units, shares, n_shards)
        split = written(split, "shard-units")
        dropped(spark, units)
        units = split
    shards = units.select("digest", "piece", F.col("node").alias("shard"))
    # Slots: rows are numbered in buckets of bounded size, offset by the buckets before.
    buckets = max(1, -(-sums["n"] // (n_shards * SLOT_ROWS)))
    placed = rows.join(shards, ["digest", "piece"]).withColumn(
        "bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "bucket", "number"), "sharded")
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", offset.alias("offset"))
    place = F.row_number().over(
        Window.partitionBy("shard", "bucket").orderBy("number", "doc_id", "text_crc32"))
    return placed.withColumn("place", place).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
