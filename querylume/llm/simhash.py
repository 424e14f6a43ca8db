"""SimHash fingerprints and the groups they form within a Hamming radius.

All pairs of distinct fingerprints are compared exactly, tile against tile, by
exclusive-or and bit counts in numpy. Tile pairs, and blocks within them, whose
population counts differ by more than the radius are never looked at.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from querylume.llm.common import chunks_of, remembers, text_key, written
from querylume.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE = 32768
PIECE_BYTES = 4 << 20
BLOCK = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text, k=SHINGLE):
    """XXH64 of each run of ``k`` words, repeats included; of all words if there are
    fewer; none for a text without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64)


def fingerprint(hashes):
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle=SHINGLE, key=False) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint ``fp``; with ``key`` also ``tk``, 128 bits of
    the text that tell rows of one id apart. Null and wordless texts have 0."""
    names = ["doc_id", *(["tk"] if key else []), "fp"]

    def compute(batches):
        remembers()
        for batch in chunks_of(batches, PIECE_BYTES):
            fp = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            given = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*given, pa.array(fp, pa.int64())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", *([text_key().alias("tk")] if key else []))
    return given.mapInArrow(compute, f"doc_id {kind}, {'tk binary, ' if key else ''}fp long")


def _tiles(distinct: DataFrame, tile: int):
    """Distinct fingerprints as packed tiles of one population count each, and how many
    tiles each of the 65 counts has."""
    ones = distinct.select("fp", F.bit_count("fp").alias("ones"))
    counts = dict(ones.groupBy("ones").count().collect())
    n_tiles = [-(-counts.get(i, 0) // tile) for i in range(65)]
    many = F.element_at(F.array(*map(F.lit, n_tiles)), F.col("ones") + 1)
    tiles = (
        ones.withColumn("part", F.pmod(F.xxhash64("fp"), many).cast("int"))
        .groupBy("ones", "part").agg(F.collect_list("fp").alias("fps"))
    )
    return tiles, n_tiles


def _signature(fps):
    """Population counts of the four 16-bit quarters; their distance bounds the bits'."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int8)


class _Forest:
    """Groups of 0 to n-1, merged by whole arrays of links."""

    def __init__(self, n):
        self.root = np.arange(n)

    def merge(self, i, j):
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            a, b, i, j = a[apart], b[apart], i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def near_links(left, right, radius):
    """Links that join all of ``left`` and ``right`` (distinct fingerprints, right None to
    compare left with itself) as the pairs within ``radius`` join them: each linked
    fingerprint with the first of its group, never all pairs of a group."""
    both = left if right is None else np.concatenate([left, right])
    forest = _Forest(len(both))
    sides = []
    for fps, base in ((left, 0), (right, len(left))):
        if fps is None:
            sides.append(sides[0])
            continue
        signature = _signature(fps)
        order = np.lexsort(signature.T[::-1])
        fps, signature = fps[order], signature[order]
        starts = range(0, len(fps), BLOCK)
        lows = np.array([signature[s:s + BLOCK].min(axis=0) for s in starts])
        highs = np.array([signature[s:s + BLOCK].max(axis=0) for s in starts])
        sides.append((fps, order + base, lows, highs))
    (a, a_at, a_low, a_high), (b, b_at, b_low, b_high) = sides
    for k in range(len(a_low)):
        gap = np.maximum(b_low - a_high[k], 0) + np.maximum(a_low[k] - b_high, 0)
        close = np.flatnonzero(gap.sum(axis=1) <= radius)
        if right is None:
            close = close[close >= k]
        rows = a[k * BLOCK:(k + 1) * BLOCK, None]
        for m in close.tolist():
            near = np.bitwise_count(rows ^ b[m * BLOCK:(m + 1) * BLOCK]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                forest.merge(a_at[i + k * BLOCK], b_at[j + m * BLOCK])
    linked = np.flatnonzero(forest.root != np.arange(len(both)))
    return both[linked], both[forest.root[linked]]


def links(distinct: DataFrame, radius=RADIUS, tile=TILE) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all pairs within
    ``radius`` bits would."""
    tiles, n_tiles = _tiles(distinct, tile)
    array = F.array(*map(F.lit, n_tiles))
    here = F.struct("ones", "part")
    sent = (
        tiles.withColumn("other", F.explode(F.sequence(
            F.greatest(F.col("ones") - radius, F.lit(0)),
            F.least(F.col("ones") + radius, F.lit(64)))))
        .withColumn("others", F.element_at(array, F.col("other") + 1))
        .filter("others > 0")
        .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("there", F.struct(F.col("other").alias("ones"), F.col("other_part").alias("part")))
        .select(F.least(here, "there").alias("low"), F.greatest(here, "there").alias("high"), "fps")
    )
    n_pairs = sum(
        x * (x + 1) // 2 + x * sum(n_tiles[i + 1:i + 1 + radius]) for i, x in enumerate(n_tiles))

    def compare(table: pa.Table) -> pa.Table:
        sides = [
            np.frombuffer(x.values.slice(x.offsets[i].as_py(), len(x[i])).to_numpy().tobytes(), np.uint64)
            for x in table.column("fps").chunks for i in range(len(x))
        ]
        u, v = near_links(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    # As many partitions as pairs of tiles, up to a bound that only limits how finely the
    # work is dealt: the bytes say nothing about it, so their merging is not wanted.
    parts = max(1, min(n_pairs, 20_000))
    return sent.repartition(parts, "low", "high").groupBy("low", "high").applyInArrow(
        compare, "u long, v long")


def _rooted(held: DataFrame, radius, tile):
    """Each distinct ``fp`` of ``held`` with the least of its group, its ``root``."""
    classes = held.select("fp").distinct()
    found = written(links(classes, radius, tile), "simhash-links")
    roots = components(found, "simhash-stars")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_groups(fps: DataFrame, radius=RADIUS, tile=TILE) -> DataFrame:
    """``fps`` (doc_id, fp; more columns stay) with component_id: the smallest doc_id among
    the documents that links of at most ``radius`` bits reach. Rows repeat as given; a
    null doc_id is carried along and never the smallest unless the group has no other."""
    held = written(fps, "fingerprints")
    rooted = written(_rooted(held, radius, tile), "simhash-roots")
    first = held.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return held.join(named, "fp")


def one_of_each(docs: DataFrame, shingle=SHINGLE, radius=RADIUS) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group: that with the
    smallest doc_id (a null is largest), of equal ones that with the smallest MD5 of its
    text (a null text first). Rows are told apart by the id and 128 bits of the text, so no
    row goes for another of the same id; of rows that repeat both one stays."""
    held = written(fingerprints(docs, shingle, key=True), "fingerprints")
    rooted = written(_rooted(held, radius, TILE), "simhash-roots")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tk")
    firsts = held.groupBy("fp").agg(F.min(order).alias("one"))
    kept = rooted.join(firsts, "fp").groupBy("root").agg(F.min("one").alias("one"))
    kept = kept.select("one.doc_id", "one.tk")
    # The columns travel in one struct, so their names cannot clash.
    rows = docs.select("doc_id", text_key().alias("tk"), F.struct("*").alias("row"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["tk"] == kept["tk"])
    found = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "tk"])
    return found.select("row.*")


def simhash_groups(docs: DataFrame, shingle=SHINGLE, radius=RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``
    (doc_id, text; more columns are ignored). No rows, no rows."""
    grouped = near_groups(fingerprints(docs, shingle), radius)
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
