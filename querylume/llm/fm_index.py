"""Benchmark passages found in documents through an FM-index per shard.

A shard is some megabytes of documents. Its words are numbered by the words of the test
phrases; runs of such words that are too short for any phrase are left out, so the
suffix array stays small. Phrases are searched backwards through the ranks of a wavelet
matrix, all at once, and located by the nearest sampled suffix position.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querylume.llm.common import chunks_of, dropped, open_store, remembers, written
from querylume.session import scratch_path

WINDOW = 10
SHARD_BYTES = 8 << 20
SAMPLE = 8
# Every task reads the test phrases; beyond this many bytes they come in blocks, one after
# the other.
PHRASE_BYTES = 16 << 20

# Words are runs of digits, lower-case letters and bytes from 0x80 on.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20 for c in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words_of(text):
    return (text or "").encode().translate(WORD_BYTES).split(b" ") if text else []


class Phrases:
    """The distinct windows of some items, and the items each belongs to."""

    def __init__(self, items, window=WINDOW):
        self.number, self.items, found = {}, [], {}
        for item_id, text in items:
            words = [w for w in words_of(text) if w]
            if not words:
                continue
            name = len(self.items)
            self.items.append("null" if item_id is None else str(item_id))
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                found.setdefault(tuple(ids[i:i + n]), []).append(name)
        self.by_length = {}
        for phrase, names in found.items():
            rows = self.by_length.setdefault(len(phrase), ([], []))
            rows[0].append(phrase)
            rows[1].append(sorted(set(names)))
        self.by_length = {n: (np.array(p), names) for n, (p, names) in self.by_length.items()}
        self.shortest = min(self.by_length, default=0)


class WaveletMatrix:
    """Ranks in a sequence of small numbers: one bit per level, with running counts."""

    def __init__(self, symbols, n_bits):
        self.levels, self.zeros, self.starts = [], [], None
        self.n_bits = n_bits
        for level in range(n_bits - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bits)]))
            self.zeros.append(len(symbols) - int(self.levels[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol, i):
        """How often each symbol occurs before place i (arrays of one length)."""
        at, start = i, np.zeros_like(i)
        for depth, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.n_bits - 1 - depth)) & 1 == 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start


def suffix_order(symbols):
    """Places of a sequence by the suffix that begins there. Zeros separate: each is a
    symbol of its own, below all others, so no comparison runs across one."""
    n = len(symbols)
    separators = symbols == 0
    rank = np.where(separators, np.cumsum(separators) - 1, symbols.astype(np.int64) + separators.sum())
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank, step = new, step * 2
        if rank.max() == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and locates phrases in a sequence of word numbers, 0 between runs."""

    def __init__(self, symbols, n_symbols):
        order = suffix_order(symbols)
        self.last = symbols[order - 1]
        self.matrix = WaveletMatrix(self.last, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        # A place is sampled if it is a multiple of SAMPLE or begins a run: from any
        # other, one step back stays within the run.
        sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled, self.places = sampled, np.where(sampled, order, -1)

    def _step(self, symbol, i):
        return self.first[symbol] + self.matrix.rank(symbol, i)

    def search(self, phrases):
        """The interval of suffixes that begin with each phrase (one row each)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last))
        for column in phrases.T[::-1]:
            low, high = self._step(column, low), self._step(column, high)
        return low, np.maximum(low, high)

    def locate(self, rows):
        """The places of the suffixes at these rows of the suffix order."""
        steps = np.zeros(len(rows), np.int64)
        while True:
            on = ~self.sampled[rows]
            if not on.any():
                return self.places[rows] + steps
            rows = rows.copy()
            rows[on] = self._step(self.last[rows[on]], rows[on])
            steps[on] += 1


def _runs(ids, bounds, shortest):
    """The parts of a shard worth indexing: runs of at least ``shortest`` numbered words
    within one document, with a 0 after each; and the shard place of every symbol."""
    known = ids > 0
    edge = np.concatenate([[True], known[1:] != known[:-1]]) if len(ids) else np.empty(0, bool)
    edge[bounds[(bounds > 0) & (bounds < len(ids))]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(ids))
    good = known[starts] & (ends - starts >= shortest) if len(starts) else np.empty(0, bool)
    starts, ends = starts[good], ends[good]
    lengths = ends - starts + 1
    offsets = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum()) - np.repeat(offsets - starts, lengths)
    stops = offsets + lengths - 1
    inside = np.ones(len(places), bool)
    inside[stops] = False
    symbols = np.zeros(len(places), np.int64)
    symbols[inside] = ids[places[inside]]
    return symbols, places


def search_shard(texts, phrases):
    """For each text: its number of words, the hit words as [start, end) runs of word
    numbers, and the items (by number) whose windows occur."""
    find = phrases.number.get
    listed = [np.array([find(w, 0) for w in words_of(t) if w], np.int64) for t in texts]
    counts = np.array([len(x) for x in listed], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ids = np.concatenate(listed) if listed else np.empty(0, np.int64)
    covered = np.zeros(len(ids) + 1, np.int64)
    items = [set() for _ in texts]
    symbols, places = _runs(ids, bounds, phrases.shortest) if phrases.by_length else ((), ())
    if len(symbols):
        index = FMIndex(symbols, len(phrases.number))
        for n, (windows, names) in phrases.by_length.items():
            low, high = index.search(windows)
            times = high - low
            which = np.repeat(np.arange(len(windows)), times)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(times) - times - low, times)
            at = places[index.locate(rows)]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
            docs = np.searchsorted(bounds, at, side="right") - 1
            pairs = np.unique(docs * len(windows) + which)
            for doc, window in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist()):
                items[doc].update(names[window])
    hit = (np.cumsum(covered[:-1]) > 0).astype(np.int8)
    edges = np.diff(np.concatenate([[0], hit, [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A run of hits may go on into the next document; cut it there.
    cuts = bounds[1:-1][(hit[bounds[1:-1] - 1] > 0) & (hit[np.minimum(bounds[1:-1], len(hit) - 1)] > 0)
                        & (bounds[1:-1] > 0) & (bounds[1:-1] < len(hit))] if len(hit) else bounds[:0]
    cuts = np.unique(cuts)
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    of = np.searchsorted(bounds, starts, side="right") - 1
    spans = [[] for _ in texts]
    for doc, a, b in zip(of.tolist(), (starts - bounds[of]).tolist(), (ends - bounds[of]).tolist()):
        spans[doc].append((a, b))
    return counts.tolist(), spans, items


def merged(spans):
    """Overlapping and touching [start, end) runs joined, in order."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ADDED = (
    "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
)


_HELD = {}


def _phrases(folder, window):
    """The phrases of one block of items, read where they were written; a worker holds one
    block at a time."""
    if (folder, window) not in _HELD:
        _HELD.clear()
        store, path = open_store(folder)
        rows = []
        for info in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                table = pq.read_table(info.path, columns=["item_id", "text"], filesystem=store, partitioning=None)
                rows += zip(*(c.to_pylist() for c in table.columns))
        _HELD[folder, window] = Phrases(rows, window)
    return _HELD[folder, window]


def _scanning(folder, window, schema, cut=False):
    def scan(batches):
        remembers()
        local = _phrases(folder, window)
        for piece in chunks_of(batches, SHARD_BYTES):
            texts = piece.column("text").to_pylist()
            counts, spans, items = search_shard(texts, local)
            columns = {name: piece.column(name) for name in piece.schema.names}
            names = [sorted({local.items[i] for i in x}) for x in items]
            if "hits" in columns:  # an earlier block of items has been here
                old = [[(h["start"], h["end"]) for h in row] for row in columns["hits"].to_pylist()]
                spans = [merged(a + b) for a, b in zip(old, spans)]
                names = [sorted({*a, *b}) for a, b in zip(columns["items"].to_pylist(), names)]
            if cut:
                columns["text"] = [without(t, x) if x else t for t, x in zip(texts, spans)]
            else:
                columns |= {"n_words": counts, "hits": [
                    [{"start": a, "end": b} for a, b in x] for x in spans], "items": names}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in schema.names}, schema=schema)
    return scan


def _blocks(benchmark, phrase_bytes):
    """The distinct items, written as a table in blocks of about ``phrase_bytes``; its folder
    and the number of blocks. Nothing of them passes through the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // phrase_bytes))
    folder = scratch_path(spark, "phrases")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    items.withColumn("block", block).write.partitionBy("block").parquet(folder)
    return folder, n_blocks


def _searched(docs, benchmark, carried, window, phrase_bytes, cut=False):
    """The blocks of items one after the other; the last one cuts the texts if asked to.
    What a block found is written before the next, so that tasks hold one at a time."""
    spark = docs.sparkSession
    folder, n_blocks = _blocks(benchmark, phrase_bytes)
    found = docs.select("doc_id", "text", *carried)
    given, before = found.schema.fields, None
    for block in range(n_blocks):
        last = block == n_blocks - 1
        schema = StructType(given if cut and last else given + StructType.fromDDL(ADDED).fields)
        scan = _scanning(f"{folder}/block={block}", window, to_arrow_schema(schema), cut and last)
        found = found.mapInArrow(scan, schema)
        if not last:
            found = written(found, "passages")
            if before is not None:
                dropped(spark, before)
            before = found
    return found


def find_passages(docs: DataFrame, benchmark: DataFrame, window=WINDOW,
                  phrase_bytes=PHRASE_BYTES) -> DataFrame:
    """doc_id and text of ``docs`` with n_words, hits (runs of words that lie in an
    occurrence of a window, as [start, end) word numbers, merged) and items (the
    item_ids whose windows occur, sorted as strings).

    A window is ``window`` consecutive words of an item of ``benchmark`` (item_id,
    text), or the whole of a shorter one. Texts that are null or hold no words have no
    windows and no hits; a null item_id is called ``null``; more columns are ignored.
    Items that repeat an id and a text are one; no items, no hits; no rows, no rows.
    """
    return _searched(docs, benchmark, (), window, phrase_bytes)


def without(text, hits):
    """``text`` without the hit words and what stands between words of one run."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.translate(WORD_BYTES))]
    kept, at = [], 0
    for a, b in hits:
        kept.append(data[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``find_passages`` finds, as counts: doc_id, n_words, n_hit, n_items,
    items_sha256 (of the item_ids joined by commas) and contaminated."""
    found = find_passages(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, window=WINDOW,
                     phrase_bytes=PHRASE_BYTES) -> DataFrame:
    """All rows and columns of ``docs``; from the text the hit words are cut, with what
    stands between words of one run. Other texts stay as they are."""
    # The other columns travel in one struct, so their names cannot clash.
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    cleaned = _searched(docs.select("doc_id", "text", row), benchmark, ["row"], window,
                        phrase_bytes, cut=True)
    return cleaned.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
