"""Fill-in-the-middle texts, put together and taken apart by sorting their pieces.

A text is cut into prefix, middle and suffix, and each of these into pieces of at most CHUNK
code points. A piece knows its document and its position in the output. One shuffle by
document with a sort inside the partitions (``repartition`` and ``sortWithinPartitions``,
the frame's form of repartitionAndSortWithinPartitions) brings the pieces into output
order, where they stream into a digest: no task holds more than one piece of a document.
Taking an output apart works on the streamed pieces alone. It finds the marks, gives every
piece its place in the text, and the same partitions are sorted once more, without another
shuffle.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from querylume.llm.common import chunks_of, remembers

CHUNK = 1 << 16
BATCH_CHARS = 4 << 20
PLAIN_FROM, SPM_BELOW = 90, 20
# The marks of the three parts, and the orders of the two forms.
MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
# The order of the parts in the text; a document's last row comes after them.
PLACES = {"P": 0, "M": 1, "S": 2}
END = 3
HEAD = ("doc_id", "n", "form", "prefix_chars", "middle_chars")


def decided(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its number ``row``, n (code points), form
    and the lengths of prefix and middle (null if plain), by digests of its doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    cuts = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    first, second = F.least(*cuts), F.greatest(*cuts)
    marked = text.contains(MARKS["P"]) | text.contains(MARKS["S"]) | text.contains(MARKS["M"])
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    text.alias("text"), F.length(text).cast("long").alias("n"))
        .withColumn("form", form)
        .withColumn("prefix_chars", F.when(F.col("form") != "plain", first))
        .withColumn("middle_chars", F.when(F.col("form") != "plain", second - first))
    )


def _head_field(docs):
    kinds = [docs.schema["doc_id"].dataType, LongType(), StringType(), LongType(), LongType()]
    return StructField("head", StructType([StructField(c, t) for c, t in zip(HEAD, kinds)]))


class _Rows:
    """Rows gathered into Arrow batches of about BATCH_CHARS of text."""

    def __init__(self, schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, *row, chars=0):
        self.rows.append(row)
        self.chars += chars

    def full(self):
        return self.chars >= BATCH_CHARS or len(self.rows) >= 50_000

    def batch(self):
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pieces_of(text, form, prefix, middle):
    """The output in order, as (position, piece), the marks in front of their parts."""
    if form == "plain":
        spans = [("", 0, len(text))] if text else []
    else:
        ends = {"P": (0, prefix), "M": (prefix, prefix + middle), "S": (prefix + middle, len(text))}
        spans = [(MARKS[p], *ends[p]) for p in ORDERS[form]]
    at = 0
    for mark, start, end in spans:
        for i in range(start, max(end, start + 1), CHUNK):
            piece = mark + text[i:min(i + CHUNK, end)]
            yield at, piece
            at += len(piece)
            mark = ""


def _cutting(schema):
    def cut(batches):
        remembers()
        out = _Rows(schema)
        for batch in chunks_of(batches, BATCH_CHARS):
            for r in batch.to_pylist():
                out.add(r["row"], -1, None, {c: r[c] for c in HEAD})
                for at, piece in pieces_of(r["text"], r["form"], r["prefix_chars"], r["middle_chars"]):
                    out.add(r["row"], at, piece, None, chars=len(piece))
                if out.full():
                    yield out.batch()
        yield out.batch()
    return cut


def output_pieces(docs: DataFrame) -> DataFrame:
    """The outputs of all rows of ``docs``, as pieces in order: row, at (position in code
    points), piece and, on a row's first line (at -1, no piece), its ``head``."""
    schema = StructType([StructField("row", LongType()), StructField("at", LongType()),
                         StructField("piece", StringType()), _head_field(docs)])
    cut = decided(docs).mapInArrow(_cutting(to_arrow_schema(schema)), schema)
    return cut.repartition("row").sortWithinPartitions("row", "at")


class _Parts:
    """An output that streams in, taken apart: (place of the part, offset in it, piece)."""

    def __init__(self, form):
        self.marks = list(ORDERS.get(form, ""))
        self.part = None if self.marks else "P"
        self.offset, self.held = 0, ""

    def _piece(self, piece):
        at, self.offset = self.offset, self.offset + len(piece)
        return PLACES[self.part], at, piece

    def feed(self, piece):
        text = self.held + piece
        self.held = ""
        while self.marks:
            at = text.find(MARKS[self.marks[0]])
            if at < 0:
                # A mark may begin at the end of this piece.
                keep = max(len(text) - 2, 0)
                text, self.held = text[:keep], text[keep:]
                break
            if at:
                yield self._piece(text[:at])
            text = text[at + len(MARKS[self.marks[0]]):]
            self.part, self.offset = self.marks.pop(0), 0
        if text:
            yield self._piece(text)

    def end(self):
        if self.held:
            yield self._piece(self.held)


def _digesting(schema):
    """Streams outputs into their digests, and their pieces on with their place in the text."""
    def digest(batches):
        remembers()
        out, row, head, sha, parts = _Rows(schema), None, None, None, None

        def finished():
            for place, at, piece in parts.end():
                out.add(row, place, at, piece, None, None, chars=len(piece))
            out.add(row, END, 0, None, head, sha.hexdigest())

        for batch in batches:
            for number, piece, about in zip(*(batch.column(c).to_pylist() for c in ("row", "piece", "head"))):
                if about is not None:
                    if head is not None:
                        finished()
                    row, head, sha, parts = number, about, hashlib.sha256(), _Parts(about["form"])
                else:
                    sha.update(piece.encode())
                    for place, at, part in parts.feed(piece):
                        out.add(row, place, at, part, None, None, chars=len(part))
                if out.full():
                    yield out.batch()
        if head is not None:
            finished()
        yield out.batch()
    return digest


def _restoring(schema):
    def restore(batches):
        sha = hashlib.sha256()
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("piece", "head", "output_sha256"))
            for piece, head, output in zip(*columns):
                if head is None:
                    sha.update(piece.encode())
                else:
                    rows.append((*(head[c] for c in HEAD), output, sha.hexdigest()))
                    sha = hashlib.sha256()
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return restore


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every
    row of ``docs`` (doc_id, text; more columns are ignored).

    The restored text is what the streamed output and its form give back. A null text is
    empty, an empty one plain; a null doc_id is hashed as empty text. Rows are told apart by
    their number, so repeated rows and ids give their rows again; the rows must come from a
    scan or a written table, which a repeated task reads in the same order. A text of any
    length passes as pieces. No rows, no rows.
    """
    head = _head_field(docs)
    placed = StructType([
        StructField("row", LongType()), StructField("place", LongType()), StructField("at", LongType()),
        StructField("piece", StringType()), head, StructField("output_sha256", StringType())])
    schema = StructType([*head.dataType.fields, StructField("output_sha256", StringType()),
                         StructField("restored_sha256", StringType())])
    streamed = output_pieces(docs).mapInArrow(_digesting(to_arrow_schema(placed)), placed)
    sorted_again = streamed.sortWithinPartitions("row", "place", "at").select("piece", "head", "output_sha256")
    return sorted_again.mapInArrow(_restoring(to_arrow_schema(schema)), schema)


def _joining(schema):
    def join(batches):
        out, head, pieces = _Rows(schema), None, []
        for batch in batches:
            for piece, about in zip(batch.column("piece").to_pylist(), batch.column("head").to_pylist()):
                if about is None:
                    pieces.append(piece)
                    continue
                if head is not None:
                    out.add(*(head[c] for c in HEAD), "".join(pieces), chars=head["n"])
                    if out.full():
                        yield out.batch()
                head, pieces = about, []
        if head is not None:
            out.add(*(head[c] for c in HEAD), "".join(pieces))
        yield out.batch()
    return join


def outputs(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and ``output``, the whole text to train
    on, of every row of ``docs``; cases as in ``digests``."""
    schema = StructType([*_head_field(docs).dataType.fields, StructField("output", StringType())])
    return output_pieces(docs).mapInArrow(_joining(to_arrow_schema(schema)), schema)
