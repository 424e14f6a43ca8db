"""Long byte strings that occur more than once, found by grouping sampled suffixes on
fingerprints, and documents without them. This replaces the sort, the merge order and the
comparison of neighbours of a difference-cover suffix sort: no suffix order is made.

A suffix starts at every byte. Only sampled suffixes are named and compared across
documents; the others between them are settled by the nearest sample:

1. Sample. The cover is taken by content instead of by residues (a string synchronizing
   set): of any RUN places in a row the one whose short name is least. Equal strings have
   their samples at equal offsets, so a suffix and its copies meet at one sample each.
2. Names. The depths of 3, 9, 27 and 81 bytes by recursion on triples (suffix_names).
   Samples whose 81-byte name occurs once are done: nothing around them repeats.
3. Classes. Samples of one name whose whole surroundings agree are one class, settled by
   their number. Only names with several classes are looked at more closely.
4. Blocks. The suffixes before a sample are compared in blocks: two suffixes of a block
   agree if the bytes all of the block's strings share have one name, and the few bytes
   left and right of these are equal.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querylume.llm import suffix_names as sn
from querylume.llm.common import KEY, chunks_of, dropped, keyed, remembers, written
from querylume.operators.joins import join_unique

LENGTH = 200
# Places in a row that share a sample; the sample's name and all it is compared by must
# lie within LENGTH bytes.
RUN = 120
SHORT, DEEP = 9, 81
BLOCK = 16
COMMON = LENGTH - BLOCK + 1
SEGMENT = 1 << 20
PLACE_BITS = 22
PIECE_BYTES = 8 << 20
assert LENGTH - (RUN - 1) >= DEEP and RUN % 8 == 0 and SEGMENT + 2 * LENGTH < 1 << PLACE_BITS

SAMPLES = "dk long, tk binary, place int, low short, high short, name long, wide long"
SAMPLE_ROWS = pa.schema([
    ("dk", pa.int64()), ("tk", pa.binary()), ("place", pa.int32()), ("low", pa.int16()),
    ("high", pa.int16()), ("name", pa.int64()), ("wide", pa.int64()),
])
BLOCKS = "name long, wide long, block int, common long, before binary, after binary"
BLOCK_ROWS = pa.schema([
    ("name", pa.int64()), ("wide", pa.int64()), ("block", pa.int32()), ("common", pa.int64()),
    ("before", pa.binary()), ("after", pa.binary()),
])


def _sample_segments(segments):
    """Samples of byte strings: (segment, place, first and last suffix it settles) and the
    deep and wide names. Suffixes run from 0 to LENGTH before a segment's end."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    lengths = np.array([len(s) for s in segments])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    deep, short = sn.names(data, DEEP, also=SHORT)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # The low bits are the place, so of equal names the first is the least.
    least = (short & ~mask) | np.arange(len(data), dtype=np.uint64)
    del short
    step = 1
    while 2 * step <= RUN:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = RUN - step
    if rest:
        least[:-rest] = np.minimum(least[:-rest], least[rest:])
    n_suffixes = np.maximum(lengths - LENGTH + 1, 0)
    total = int(n_suffixes.sum())
    if not total:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    owner = np.repeat(np.arange(len(segments)), n_suffixes)
    suffix = np.arange(total) + np.repeat(starts - np.cumsum(n_suffixes) + n_suffixes, n_suffixes)
    place = (least[suffix] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(
        [[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:], total) - 1
    owner, place, low, high = owner[first], place[first], suffix[first], suffix[last]
    wide = sn.spanning(deep, low, high - low + LENGTH, DEEP, seed=1)
    base = starts[owner]
    return owner, place - base, low - base, high - base, deep[place], wide


def _wide_name(data):
    deep = sn.names(np.frombuffer(data, np.uint8), DEEP)
    return sn.spanning(deep, np.array([0]), np.array([len(data)]), DEEP, seed=1)[0]


def sample_texts(texts):
    """Samples of whole texts (bytes): arrays of text number, place, low and high (how far
    before the sample the nearest and the farthest suffix start) and the two names."""
    parts, held, size = [], [], 0

    def flush():
        nonlocal held, size
        if held:
            owner, place, low, high, deep, wide = _sample_segments([s for _, _, s in held])
            number = np.array([i for i, _, _ in held])[owner]
            offset = np.array([o for _, o, _ in held])[owner]
            parts.append([number, place + offset, low + offset, high + offset, deep, wide])
        held, size = [], 0

    for i, data in enumerate(texts):
        for offset in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
            segment = data[offset:offset + SEGMENT + LENGTH - 1]
            if size + len(segment) > SEGMENT + LENGTH:
                flush()
            held.append((i, offset, segment))
            size += len(segment)
    flush()
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    number, place, first, last, deep, wide = map(np.concatenate, zip(*parts))
    # A sample that settles suffixes of two segments of one text is one sample.
    twice = np.flatnonzero((number[1:] == number[:-1]) & (place[1:] == place[:-1]))
    if len(twice):
        first[twice + 1] = first[twice]
        for k in (twice + 1).tolist():
            wide[k] = _wide_name(texts[number[k]][first[k]:last[k] + LENGTH])
        keep = np.ones(len(number), bool)
        keep[twice] = False
        number, place, first, last, deep, wide = (
            x[keep] for x in (number, place, first, last, deep, wide))
    return number, place, place - last, place - first, deep.view(np.int64), wide.view(np.int64)


def _sampling(batches):
    remembers()
    for batch in chunks_of(batches, SEGMENT):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        number, place, low, high, deep, wide = sample_texts(texts)
        keys = [batch.column(c).take(pa.array(number)) for c in KEY]
        columns = [place.astype(np.int32), low.astype(np.int16), high.astype(np.int16), deep, wide]
        yield pa.RecordBatch.from_arrays(
            [*keys, *(pa.array(c) for c in columns)], schema=SAMPLE_ROWS)


def _blocks_of(data, place, low, high):
    """For each block of suffixes the sample settles: its number, its shared bytes, and
    those before and after them that its strings reach."""
    for block in range(low // BLOCK, high // BLOCK + 1):
        nearest = max(low - block * BLOCK, 0)
        farthest = min(high - block * BLOCK, BLOCK - 1)
        start = place - block * BLOCK
        end = start + COMMON
        yield (block, data[start:end], data[start - farthest:start],
               data[end:end + BLOCK - 1 - nearest])


def _cutting(batches):
    remembers()
    for batch in chunks_of(batches, SEGMENT):
        rows = []
        for text, samples in zip(batch.column("text").to_pylist(), batch.column("samples").to_pylist()):
            data = text.encode()
            rows += [
                (s["name"], s["wide"], *b)
                for s in samples for b in _blocks_of(data, s["place"], s["low"], s["high"])
            ]
        for at in range(0, len(rows), 20_000):
            name, wide, block, common, before, after = zip(*rows[at:at + 20_000])
            deep = sn.names(np.frombuffer(b"".join(common), np.uint8), DEEP, seed=1)
            n = len(common)
            places = np.arange(n) * COMMON
            common = sn.spanning(deep, places, np.full(n, COMMON), DEEP, seed=0).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"name": name, "wide": wide, "block": block, "common": common,
                 "before": before, "after": after}, schema=BLOCK_ROWS)


def _settled_blocks(blocks: DataFrame) -> DataFrame:
    """name, wide, and offsets: how far before the sample the suffixes start whose strings
    occur in another class too."""
    key = ["name", "block", "common"]
    kinds = blocks.groupBy(*key, "before", "after").agg(F.count("*").alias("n"))
    groups = kinds.groupBy(*key).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    known = written(kinds.join(groups.filter("total > 1"), key), "suffix-kinds")
    # The i-th suffix of a block has i bytes before the shared ones and the rest after.
    steps = F.expr(f"sequence({BLOCK} - 1 - length(after), length(before))")
    single = known.filter("kinds > 1").select(*key, "before", "after", "n", F.explode(steps).alias("i"))
    strings = single.select(*key, "before", "after", "n", "i", F.xxhash64(
        F.expr("substring(before, length(before) - i + 1, i)"),
        F.expr(f"substring(after, 1, {BLOCK} - 1 - i)")).alias("around"))
    repeated = strings.groupBy(*key, "i", "around").agg(F.sum("n").alias("times")).filter("times > 1")
    found = strings.filter("n = 1").join(repeated, [*key, "i", "around"], "left_semi")
    partly = found.groupBy(*key, "before", "after").agg(F.collect_list("i").alias("steps"))
    wholly = known.filter("n > 1").select(*key, "before", "after", steps.alias("steps"))
    settled = wholly.unionByName(partly)
    offsets = F.expr(f"transform(steps, i -> int(i + block * {BLOCK}))")
    return (
        blocks.join(settled, [*key, "before", "after"])
        .groupBy("name", "wide").agg(F.flatten(F.collect_list(offsets)).alias("offsets"))
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """dk, tk and spans: runs of bytes (start, end), at least LENGTH long and not merged,
    of each text of ``docs`` (doc_id, text) that has strings of LENGTH bytes occurring
    more than once."""
    spark = docs.sparkSession
    texts = keyed(docs)
    long_enough = texts.filter(F.octet_length("text") >= LENGTH)
    samples = written(long_enough.mapInArrow(_sampling, SAMPLES), "suffix-samples")
    names = samples.groupBy("name").agg(
        F.count("*").alias("n"), (F.min("wide") != F.max("wide")).alias("mixed")).filter("n > 1")
    shared = written(names, "suffix-names")
    again = written(join_unique(samples, shared, ["name"], "n").drop("n"), "suffix-again")
    dropped(spark, samples, shared)
    mixed = again.filter("mixed")
    classes = mixed.groupBy("name", "wide").agg(
        F.count("*").alias("n"),
        F.min(F.struct(*KEY, "place", "low", "high")).alias("one"))
    classes = written(classes.select("name", "wide", "n", "one.*"), "suffix-classes")
    wanted = classes.groupBy(*KEY).agg(F.collect_list(
        F.struct("name", "wide", "place", "low", "high")).alias("samples"))
    # Rows that repeat an id and a text would name their class twice.
    blocks = written(
        texts.join(wanted, KEY).select("text", "samples").mapInArrow(_cutting, BLOCKS)
        .distinct(), "suffix-blocks")
    dropped(spark)
    settled = written(_settled_blocks(blocks), "suffix-settled")
    dropped(spark, blocks)
    whole = F.array(F.struct(
        (F.col("place") - F.col("high")).alias("start"),
        (F.col("place") - F.col("low") + LENGTH).alias("end")))
    known = classes.select("name", "wide", "n").join(settled, ["name", "wide"], "left").filter(
        "n > 1 or offsets is not null")
    some = F.transform("offsets", lambda d: F.struct(
        (F.col("place") - d).alias("start"), (F.col("place") - d + LENGTH).alias("end")))
    spans = (
        again.filter("not mixed").select(*KEY, whole.alias("s")).unionByName(
            mixed.join(known, ["name", "wide"]).select(
                *KEY, F.when(F.col("n") > 1, whole).otherwise(some).alias("s")))
    )
    # Rows that repeat an id and a text find the same spans: a set, filled before the shuffle
    # too, holds them once, so that it is bounded by one text however many the rows are.
    found = written(
        spans.groupBy(*KEY).agg(F.flatten(F.collect_set("s")).alias("spans")), "suffix-spans")
    dropped(spark, again, classes, settled)
    return found


def _merged(spans):
    """Runs [start, end) joined where they overlap or touch."""
    flat = spans.values.flatten()
    starts, ends = (x.to_numpy() for x in flat)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return list(zip(starts[new].tolist(), ends[last].tolist()))


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _removing(schema):
    def remove(batches):
        remembers()
        for batch in chunks_of(batches, PIECE_BYTES):
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = (text.as_py() or "").encode()
                runs = _merged(spans) if spans.is_valid else []
                at, parts = 0, []
                for start, end in runs:
                    parts.append(data[at:start])
                    at = end
                kept = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(runs),
                             hashlib.sha256(kept).hexdigest(),
                             kept.decode(errors="ignore") if text.is_valid else None))
            columns = [batch.column(n) for n in batch.schema.names if n not in ("text", "spans")]
            more = [pa.array(x, schema.field(k - 5).type) for k, x in
                    enumerate(zip(*rows) if rows else [[]] * 5, len(schema))]
            yield pa.RecordBatch.from_arrays([*columns, *more], schema=schema)
    return remove


def _judged(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns but the text, with what is removed and kept."""
    spans = repeated_spans(docs.select("doc_id", "text"))
    row = F.struct(*(c for c in docs.columns if c != "text"))
    given = keyed(docs, row.alias("row"))
    joined = given.join(spans, KEY, "left").select("row", "text", "spans")
    schema = StructType(joined.select("row").schema.fields + StructType.fromDDL(REMOVED).fields)
    return joined.mapInArrow(_removing(to_arrow_schema(schema)), schema)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of every row of ``docs`` (integer doc_id, text; more columns are ignored) with n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that are left) and
    kept, the text that is left, without the parts of characters that were cut.

    Every byte is removed that is covered by a string of LENGTH bytes starting at another
    place too, in the same text or another; all occurrences go, and strings are judged on
    the input. Null texts are empty and stay null, texts shorter than LENGTH stay as they
    are. Rows that repeat an id and a text repeat all its strings. Rows are told apart by the id,
    if they have one, and 128 bits of the text. No rows, no rows.
    """
    judged = _judged(docs.select("doc_id", "text"))
    return judged.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the text being what ``repeats`` leaves of it."""
    judged = _judged(docs)
    return judged.select(*(F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`")
                           for c in docs.columns))
