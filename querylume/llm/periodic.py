"""Periodic runs of words: stretches that repeat their first words at least four times.

A run of period q and length L has L - q places in a row whose word equals the one q words
later, at least ``max(6, 4q) - q``. A grid of that spacing therefore meets every run of the
period, and all grids together hold some n log(n) / 3 places. From a place whose two words
are equal, two extensions read off the grammar of the text give the whole run.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querylume.llm.common import chunks_of, remembers
from querylume.llm.grammar import Grammar

TIMES, LEAST = 4, 6
PIECE_BYTES = 2 << 20
QUERIES_AT_ONCE = 1 << 18
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
WORD = r"[^\x20\x09-\x0D]+"


def _candidates(symbols, longest):
    """Places and periods of the grids whose word equals the one a period later, at most
    about QUERIES_AT_ONCE together, by rising period."""
    at, periods, held = [], [], 0
    for q in range(1, longest // TIMES + 1):
        spacing = max(LEAST, TIMES * q) - q
        found = np.flatnonzero(symbols[:-q:spacing] == symbols[q::spacing]) * spacing
        if len(found):
            at.append(found)
            periods.append(np.full(len(found), q))
            held += len(found)
        if held >= QUERIES_AT_ONCE:
            yield np.concatenate(at), np.concatenate(periods)
            at, periods, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(periods)


def runs_of(texts):
    """The runs of several sequences of small integers: arrays of the sequence's number,
    start, length and period, by sequence, start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # Every sequence stands between two symbols that occur nowhere else, so no equal
    # stretch goes past its ends.
    ends = np.cumsum(lengths + 1)
    total = int(ends[-1]) + 1 if len(texts) else 1
    symbols = np.empty(total, np.int64)
    marks = np.append(0, ends)
    inside = np.ones(total, bool)
    inside[marks] = False
    if len(texts):
        symbols[inside] = np.concatenate(texts)
    symbols[marks] = symbols[inside].max(initial=0) + 1 + np.arange(len(marks))
    found, grammar = [], None
    for at, period in _candidates(symbols, int(lengths.max(initial=0))):
        grammar = grammar or Grammar(symbols)
        for k in range(0, len(at), QUERIES_AT_ONCE):
            i, q = at[k:k + QUERIES_AT_ONCE], period[k:k + QUERIES_AT_ONCE]
            start = i - grammar.extensions_back(i, i + q)
            length = i + q + grammar.extensions(i, i + q) - start
            whole = length >= np.maximum(LEAST, TIMES * q)
            found.append(np.unique(np.stack([start[whole], length[whole], q[whole]]), axis=1))
    if not found:
        return (np.empty(0, np.int64),) * 4
    start, length, q = np.concatenate(found, axis=1)
    # A run is met by every multiple of its period too; the least is its period.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, q = start[first], length[first], q[first]
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    owner = np.searchsorted(marks, start, side="right") - 1
    return owner, start - marks[owner] - 1, length, q


def _kept(words, start, length, period):
    """The words no run repeats: those in none, or among the first ``period`` of all."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _finding(schema):
    def find(batches):
        remembers()
        for batch in chunks_of(batches, PIECE_BYTES):
            texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            names = {}
            numbers = [np.array([names.setdefault(w, len(names)) for w in t], np.int64) for t in texts]
            owner, *found = runs_of(numbers)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            n_words, runs, collapsed = [], [], []
            for words, lo, hi in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
                mine = [x[lo:hi] for x in found]
                n_words.append(len(words))
                runs.append([{"start": s, "length": n, "period": q}
                             for s, n, q in zip(*(x.tolist() for x in mine))])
                collapsed.append(b" ".join(_kept(words, *mine) if hi > lo else words).decode())
            given = [batch.column(c) for c in batch.schema.names if c != "text"]
            made = [pa.array(x, schema.field(k - 3).type)
                    for k, x in enumerate((n_words, runs, collapsed))]
            yield pa.RecordBatch.from_arrays([*given, *made], schema=schema)
    return find


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id of every row of ``docs`` (doc_id, text; more columns are ignored) with n_words,
    ``runs`` (start, length and period in words, by start, then period) and ``collapsed``,
    the text with one space between the words that no run repeats.

    A run is a stretch of words with smallest period q, of at least LEAST words and TIMES
    periods, that no neighbouring word extends. Words are bytes between ASCII white space.
    Null and wordless texts have no run and an empty ``collapsed``. Rows are handled one by
    one, so repeated ones, and null or repeated ids, give their rows again. The memory of a
    task grows with its longest single text, some 200 bytes a word. No rows, no rows.
    """
    rows = docs.select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(FOUND).fields])
    return rows.mapInArrow(_finding(to_arrow_schema(schema)), schema)


def digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, as one flat row per document: the number of runs, the
    longest one (of equal ones the first by start, then period; nulls without one) and
    digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("one"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("one.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("one.s")).alias("start"), F.col("one.length").alias("length"),
        period.alias("period"),
        F.floor(F.col("one.length") * 1000 / period).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the words of every tenth id, by its digest, made periodic
    from some place on. Rows without an id stay as they are."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", digest.alias("h"),
                       F.when(digest % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("ws"))
    sized = some.select("doc_id", "text", "ws", F.coalesce(F.size("ws"), F.lit(0)).alias("n"),
                        F.floor(F.col("h") / 10).alias("g"))
    begin = F.col("g") % F.col("n")
    placed = sized.select("doc_id", "text", "ws", "n", "g", F.when(F.col("n") > 0, begin).alias("a"))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    planted = F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get(F.col("ws"), source(i).cast("int"))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
