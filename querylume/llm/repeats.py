"""Passages of words that were there before, found by shared symbols of recompression.

Windows of WINDOW words are compared by way of the symbols in them (``word_symbols``):

1. Naming. The rounds of recompression run over every text; names are fingerprints, so that
   equal words get equal symbols everywhere. Each window is represented by one symbol that
   its words alone decide. Neighbouring windows share theirs: one sample, for some eight
   words.
2. Reveal. Samples whose symbol occurs once in the whole table are done: nothing around
   them repeats.
3. Classes. Samples of one symbol whose windows agree altogether are one class. All but the
   first of a class go, whatever else there is.
4. Verify. Where a symbol has several classes, the windows of the first of each are compared
   one by one, by 128 bits of their words, and the earliest of equal ones stays.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querylume.llm import word_symbols as ws
from querylume.llm.common import KEY, chunks_of, dropped, keyed, remembers, written
from querylume.operators.joins import join_unique

WINDOW = 20
PIECE_BYTES = 2 << 20
SEGMENT = 1 << 19
SAMPLES = "dk long, tk binary, first int, last int, name long, wide long"
SAMPLE_ROWS = pa.schema([
    ("dk", pa.int64()), ("tk", pa.binary()), ("first", pa.int32()), ("last", pa.int32()),
    ("name", pa.int64()), ("wide", pa.int64()),
])
WINDOWS = "dk long, tk binary, first int, high long, low long"
WINDOW_ROWS = pa.schema([
    ("dk", pa.int64()), ("tk", pa.binary()), ("first", pa.int32()), ("high", pa.int64()),
    ("low", pa.int64()),
])


class _Names:
    """The words of a chunk of texts as two columns of 64-bit names."""

    def __init__(self, texts):
        seen = {}
        self.lengths = np.array([len(t) for t in texts], np.int64)
        number = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t], np.int64)
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in seen)
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        self.one, self.two = both[number, 0] | np.uint64(1), both[number, 1]


def samples_of(texts, window=WINDOW):
    """Samples of texts (lists of words): arrays of the text's number, its first and last
    window with one symbol, the symbol's name, and a name for all words of the windows."""
    names = _Names(texts)
    ends = np.cumsum(names.lengths)
    starts = ends - names.lengths
    parts = []
    for at in range(0, len(names.one), SEGMENT):
        # Windows that begin here; the words of the last ones reach into the next segment.
        stop = min(at + SEGMENT, len(names.one))
        one, two = (x[at:stop + window - 1] for x in (names.one, names.two))
        owner = np.searchsorted(ends, np.arange(at, stop), side="right")
        begin = np.flatnonzero(np.arange(at, stop) + window <= ends[owner])
        owner = owner[begin]
        if not len(begin):
            continue
        name, place = ws.anchors(one, window, begin)
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (name[1:] != name[:-1])
                                       | (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)))
        last = begin[np.append(new[1:], len(begin)) - 1]
        first, name, place, owner = begin[new], name[new], place[new], owner[new]
        wide = ws.stretches(two, first, last + window, 1)
        wide = ws.mixed(wide + (place - first).astype(np.uint64), 3)
        base = starts[owner] - at
        parts.append((owner, first - base, last - base, name, wide))
    if not parts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(map(np.concatenate, zip(*parts)))


def _words(column):
    return [(t or "").encode().split() for t in column.to_pylist()]


def _sampling(batches):
    remembers()
    for batch in chunks_of(batches, PIECE_BYTES):
        number, first, last, name, wide = samples_of(_words(batch.column("text")))
        of = pa.array(number)
        yield pa.RecordBatch.from_arrays([
            batch.column("dk").take(of), batch.column("tk").take(of), pa.array(first.astype(np.int32)),
            pa.array(last.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(wide.view(np.int64)),
        ], schema=SAMPLE_ROWS)


def _windowing(batches):
    """The windows of the stretches (first to last) wanted of each text, by 128 bits."""
    remembers()
    for batch in chunks_of(batches, PIECE_BYTES):
        names = _Names(_words(batch.column("text")))
        wanted = batch.column("wanted")
        of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        first, last = (x.to_numpy() for x in wanted.flatten().flatten())
        many = (last - first + 1).astype(np.int64)
        of = np.repeat(of, many)
        place = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        base = (np.cumsum(names.lengths) - names.lengths)[of] + place
        halves = [ws.stretches(x, base, base + WINDOW, k).view(np.int64)
                  for k, x in enumerate((names.one, names.two))]
        of = pa.array(of)
        for k in range(0, max(len(of), 1), 100_000):
            some = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([
                batch.column("dk").take(of[some]), batch.column("tk").take(of[some]),
                pa.array(place[some].astype(np.int32)), *(pa.array(h[some]) for h in halves)],
                schema=WINDOW_ROWS)


def _not_first(rows: DataFrame, groups: DataFrame, keys) -> DataFrame:
    """The rows of groups (``keys``, n and their least place ``least``) but the least."""
    joined = join_unique(rows, groups, keys, "n")
    return joined.filter(~F.struct(*KEY, "first").eqNullSafe(F.col("least")))


def _groups(rows: DataFrame, keys, *more) -> DataFrame:
    place = F.struct(*KEY, "first")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("least"), *more)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """dk, tk and spans: stretches of words (start, end), not merged, of each text of
    ``docs`` that are windows seen earlier."""
    spark = docs.sparkSession
    texts = keyed(docs)
    samples = written(texts.mapInArrow(_sampling, SAMPLES), "word-samples")
    names = samples.groupBy("name").agg(
        F.count("*").alias("n"), (F.min("wide") != F.max("wide")).alias("mixed"))
    shared = written(names.filter("n > 1"), "word-names")
    again = written(join_unique(samples, shared, ["name"], "n").drop("n"), "word-again")
    dropped(spark, samples, shared)
    classes = written(_groups(
        again, ["name", "wide"], F.any_value("mixed").alias("mixed"),
        F.min(F.struct(*KEY, "first", "last"))["last"].alias("last")), "word-classes")
    copies = _not_first(again, classes.filter("n > 1").select("name", "wide", "n", "least"), ["name", "wide"])
    copies = copies.select(*KEY, F.struct(
        F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end")).alias("s"))
    stretch = F.struct(F.col("least.first").alias("first"), F.col("last").alias("last"))
    wanted = classes.filter("mixed").select("least.dk", "least.tk", stretch.alias("w")).groupBy(*KEY).agg(
        F.collect_set("w").alias("wanted"))
    windows = written(texts.join(wanted, KEY).select(*KEY, "text", "wanted")
                      .mapInArrow(_windowing, WINDOWS), "word-windows")
    dropped(spark)
    same = written(windows.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1"), "word-same")
    equal = written(join_unique(windows, same, ["high", "low"], "n").drop("n"), "word-equal")
    dropped(spark, windows, same)
    single = _not_first(equal, written(_groups(equal, ["high", "low"]), "word-least"), ["high", "low"]).select(*KEY, F.struct(
        F.col("first").alias("start"), (F.col("first") + WINDOW).alias("end")).alias("s"))
    # A set, filled before the shuffle too: rows that repeat an id and a text find the same.
    found = written(copies.unionByName(single).groupBy(*KEY).agg(
        F.collect_set("s").alias("spans")), "word-spans")
    dropped(spark, again, classes, equal)
    return found


REMOVED = "n_words long, n_removed long, kept string"


def _removing(schema):
    def remove(batches):
        remembers()
        for batch in chunks_of(batches, PIECE_BYTES):
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split()
                kept = words
                if spans.is_valid:
                    start, end = (x.to_numpy() for x in spans.values.flatten())
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, end, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                rows.append((len(words), len(words) - len(kept),
                             b" ".join(kept).decode() if text.is_valid else None))
            given = [batch.column(n) for n in batch.schema.names if n not in ("text", "spans")]
            made = [pa.array(x, schema.field(k - 3).type) for k, x in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([*given, *made], schema=schema)
    return remove


def _judged(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns but the text, with what is removed and kept."""
    spans = repeated_spans(docs.select("doc_id", "text"))
    given = keyed(docs, F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    joined = given.join(spans, KEY, "left").select("row", "text", "spans")
    schema = StructType(joined.select("row").schema.fields + StructType.fromDDL(REMOVED).fields)
    return joined.mapInArrow(_removing(to_arrow_schema(schema)), schema)


def first_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id of every row of ``docs`` (integer doc_id, text; more columns are ignored) with
    n_words, n_removed and ``kept``, the text with one space between the words that are left.

    A window is WINDOW words in a row of one text, words being bytes between ASCII white
    space. Every word is removed that a window covers whose words also start earlier: in a
    text with a smaller doc_id, or earlier in the same. Windows are judged on the input.
    Texts without an id come after all others; of texts with one id (or none) the earlier is
    the one with the smaller MD5. Rows that repeat an id and a text are one text given
    several times and fare alike. Null texts have no words and keep a null; shorter texts
    than a window keep all their words. No rows, no rows.
    """
    judged = _judged(docs.select("doc_id", "text"))
    return judged.select("row.doc_id", "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the text being what ``first_occurrences`` keeps."""
    judged = _judged(docs)
    return judged.select(*(F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`")
                           for c in docs.columns))
