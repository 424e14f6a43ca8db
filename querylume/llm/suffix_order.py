"""Repeated strings by a difference-cover order of all suffixes, as it is written in books:
sampled triples are sorted, their names are ordered by recursion, the suffixes between are
merged in, and the prefixes of neighbours are compared. ``suffix_dedup`` finds the same
strings with far fewer rows; tests hold each of the two against brute force.

A string is a set of rows (row, chain, idx, s): the symbols of a text, or of one chain of the
names of its triples. Orders are bounded: places whose next LENGTH bytes differ are ordered
by them, other places lie next to each other in any order.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from querylume.llm.common import KEY, chunks_of, dropped, keyed, written
from querylume.operators.joins import join_unique

LENGTH = 200
PIECE_BYTES = 1 << 20
END = -1  # what follows the last symbol: less than any symbol, name or rank
PLACE = ["row", "chain", "idx"]
BYTES = "row long, chain long, idx long, s long, prefix binary"
BYTE_ROWS = pa.schema([("row", pa.int64()), ("chain", pa.int64()), ("idx", pa.int64()),
                       ("s", pa.int64()), ("prefix", pa.binary())])


def _exploding(length):
    """One row per byte; ``prefix`` is a digest of the ``length`` bytes from there, null
    where fewer are left."""
    def explode(batches):
        for batch in chunks_of(batches, PIECE_BYTES):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                data = text.as_py().encode()
                for at in range(0, len(data), PIECE_BYTES):
                    part = data[at:at + PIECE_BYTES]
                    n = len(part)
                    full = range(at, min(at + n, len(data) - length + 1))
                    prefix = [hashlib.md5(data[i:i + length]).digest() for i in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, row)), pa.array(np.zeros(n, np.int64)),
                        pa.array(np.arange(at, at + n)),
                        pa.array(np.frombuffer(part, np.uint8).astype(np.int64)),
                        pa.array(prefix + [None] * (n - len(prefix)), pa.binary()),
                    ], schema=BYTE_ROWS)
    return explode


def _sorted_numbers(keys: DataFrame, by, label) -> DataFrame:
    """``keys``, distinct in ``by``, with ``part`` and ``number`` that grow in their order."""
    ranged = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.select("*", F.spark_partition_id().alias("part"),
                                 F.monotonically_increasing_id().alias("number")), label)


def _names(symbols: DataFrame) -> DataFrame:
    """The next string: sampled triples (idx mod 3 is 1 or 2) named in sorted order, the
    two residues of a chain as chains of their own."""
    at = F.col("idx")
    shifts = F.explode(F.array(*(F.struct((at - d).alias("at"), F.lit(d).alias("d")) for d in range(3))))
    dealt = symbols.select("row", "chain", "s", shifts.alias("x")).select("row", "chain", "s", "x.*")
    sampled = dealt.filter("at > 0 and at % 3 != 0")
    part = lambda d: F.coalesce(F.max(F.when(F.col("d") == d, F.col("s"))), F.lit(END))
    triple = ["a", "b", "c"]
    triples = written(sampled.groupBy("row", "chain", "at").agg(
        *(part(d).alias(name) for d, name in enumerate(triple))), "order-triples")
    distinct = triples.groupBy(*triple).agg(F.count("*").alias("n"))
    numbered = _sorted_numbers(distinct, triple, "order-names").drop("part")
    named = written(join_unique(triples, numbered, triple, "n").select(
        "row", (F.col("chain") * 2 + F.col("at") % 3 - 1).alias("chain"),
        F.expr("at div 3").alias("idx"), F.col("number").alias("s")), "order-string")
    dropped(symbols.sparkSession, triples, numbered)
    return named


def _less(rows: DataFrame, by, classes) -> DataFrame:
    """How many rows of each of two classes are less than each row in the order ``by``:
    PLACE, cls and one count per class, ``n<class>``."""
    counts = [f"n{c}" for c in classes]
    keys = rows.groupBy(*by).agg(F.count("*").alias("n"), *(
        F.count_if(F.col("cls") == c).alias(name) for c, name in zip(classes, counts)))
    keys = _sorted_numbers(keys, by, "order-keys")
    # One row per partition: the only window that is not split.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = keys.groupBy("part").agg(*(F.sum(c).alias(c) for c in counts)).select(
        "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in counts))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    less = keys.join(F.broadcast(bases), "part").select(
        *by, "n", *((F.col(f"base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(c)
                    for c in counts))
    less = written(less, "order-less")
    out = written(join_unique(rows, less, by, "n").select(*PLACE, "cls", *counts), "order-counts")
    dropped(rows.sparkSession, keys, less)
    return out


def _merged(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks of all places of a string from those of the sampled ones: how many suffixes of
    each residue are less. Two residues are compared by the symbols up to the next places
    that are both sampled, and their ranks."""
    sampled = ranks.select(
        "row", F.expr("chain div 2").alias("chain"),
        (F.col("idx") * 3 + 1 + F.col("chain") % 2).alias("idx"), F.col("r"))
    given = symbols.select(*PLACE, "s", F.lit(None).cast("long").alias("r")).unionByName(
        sampled.select(*PLACE, F.lit(None).cast("long").alias("s"), "r"))
    at = F.col("idx")
    shifts = F.explode(F.array(*(F.struct((at - d).alias("at"), F.lit(d).alias("d")) for d in range(3))))
    dealt = given.select("row", "chain", "s", "r", shifts.alias("x")).filter("x.at >= 0")

    def part(column, d):
        return F.coalesce(F.max(F.when(F.col("x.d") == d, F.col(column))), F.lit(END))

    rows = written(dealt.groupBy("row", "chain", F.col("x.at").alias("idx")).agg(
        part("s", 0).alias("s0"), part("s", 1).alias("s1"), part("r", 0).alias("r0"),
        part("r", 1).alias("r1"), part("r", 2).alias("r2"),
    ).withColumn("cls", (F.col("idx") % 3).cast("int")), "order-merge")
    one = _less(rows.filter("cls != 2"), ["s0", "r1"], (0, 1))
    two = _less(rows.filter("cls != 1"), ["s0", "s1", "r2"], (0, 2))
    own = _less(rows.filter("cls != 0"), ["r0"], (1, 2))
    # Each place has two of the three rows; numbers of its own residue come from the first.
    counted = (
        one.select(*PLACE, (F.col("n0") + F.col("n1")).alias("k"))
        .unionByName(two.select(*PLACE, F.when(F.col("cls") == 0, F.col("n2"))
                                .otherwise(F.col("n0") + F.col("n2")).alias("k")))
        .unionByName(own.select(*PLACE, F.when(F.col("cls") == 1, F.col("n2"))
                                .otherwise(F.col("n1")).alias("k"))))
    out = written(counted.groupBy(*PLACE).agg(F.sum("k").alias("r")), "order-ranks")
    dropped(symbols.sparkSession, rows, one, two, own)
    return out


def _ranked(symbols: DataFrame, depth, length) -> DataFrame:
    """PLACE and r of every place, ordered by at least ``length`` bytes; a symbol stands
    for ``depth`` bytes."""
    if depth >= length:
        return symbols.withColumnRenamed("s", "r")
    names = _names(symbols)
    ranks = _ranked(names, depth * 3, length)
    out = _merged(symbols, ranks)
    dropped(symbols.sparkSession, names)
    return out


def _repeated(ranked: DataFrame) -> DataFrame:
    """row and idx of the places whose prefix is that of a neighbour in the order."""
    by = ["r", "row", "idx"]
    line = _sorted_numbers(ranked, by, "order-line")
    # A place alone in its partition is compared across both seams: one row per partition.
    ends = line.groupBy("part").agg(
        F.min_by("prefix", "number").alias("first"), F.max_by("prefix", "number").alias("last"))
    parts = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(parts).alias("before"),
                       F.lead("first").over(parts).alias("after"))
    inside = Window.partitionBy("part").orderBy("number")
    beside = line.join(F.broadcast(ends), "part").select(
        "row", "idx", "prefix",
        F.coalesce(F.lag("prefix").over(inside), "before").alias("left"),
        F.coalesce(F.lead("prefix").over(inside), "after").alias("right"))
    return beside.filter("prefix = left or prefix = right").select("row", "idx")


def repeated_spans(docs: DataFrame, length=LENGTH) -> DataFrame:
    """dk, tk and spans, as ``suffix_dedup.repeated_spans`` returns them: one span of
    ``length`` bytes for each place of a text of ``docs`` (doc_id, text; more columns are
    ignored) whose string of that length starts anywhere else too, in the same text or
    another. Null, empty and shorter texts have none, and no rows give no rows. Rows that
    repeat an id and a text repeat all its strings and have one set of spans.
    """
    spark = docs.sparkSession
    texts = keyed(docs).filter(F.octet_length("text") >= length)
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "order-texts")
    symbols = written(texts.select("row", "text").mapInArrow(_exploding(length), BYTES), "order-bytes")
    ranks = _ranked(symbols.drop("prefix"), 1, length)
    full = symbols.filter("prefix is not null").select("row", "idx", "prefix")
    again = _repeated(full.join(ranks.select("row", "idx", "r"), ["row", "idx"]))
    spans = F.collect_set(F.struct(
        F.col("idx").cast("int").alias("start"), (F.col("idx") + length).cast("int").alias("end")))
    found = written(again.join(texts.select("row", *KEY), "row").groupBy(*KEY).agg(
        spans.alias("spans")), "order-spans")
    dropped(spark, texts, symbols, ranks)
    return found
