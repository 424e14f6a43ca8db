"""SentencePiece encoding by an Aho-Corasick automaton and one Viterbi pass, and decoding.

The automaton holds all pieces of a vocabulary. It reads a text once; at each position
its output links give the pieces that end there, longest first, and each of them relaxes
the best score of the position. The segmentation with the highest sum of scores wins;
of equal ones that whose last piece is longer.
"""

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from querylume.llm.common import chunks_of, remembers

# Fixed values of the format: kinds of pieces, the sign for a space, the penalties.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
UNKNOWN_PENALTY, USER_PENALTY = 10.0, 0.1

MEMO = 500_000
LONGEST_REMEMBERED = 64
PIECE_BYTES = 4 << 20
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_ENCODERS = {}


class PieceEncoder:
    """Ids of texts under a SentencePiece vocabulary file, and texts of ids."""

    def __init__(self, path):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        normal = [p.score for p in proto.pieces if p.type == NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = least - UNKNOWN_PENALTY
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.dtype = np.dtype("<u2" if len(kinds) <= 1 << 16 else "<u4")
        self.automaton = ahocorasick.Automaton()
        known = []
        for i, piece in enumerate(proto.pieces):
            if piece.type in (NORMAL, USER_DEFINED):
                score = piece.score if piece.type == NORMAL else len(piece.piece) * most - USER_PENALTY
                self.automaton.add_word(piece.piece, (len(piece.piece), score, i))
                known.append(piece.piece)
        self.automaton.make_automaton()
        self.chunk = re.compile(self._chunks(known))
        spec = proto.normalizer_spec
        plain = spec.name == "identity" and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.prefix = spec.add_dummy_prefix
        self.library = None if plain else sentencepiece.SentencePieceProcessor(model_file=path)
        self.decoded = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL
            else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds)
        ]
        self.memo = {}

    @staticmethod
    def _chunks(known):
        """A pattern that cuts a text only where no piece can lie across the cut."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known):
            return r"(?s).+"
        if any("\n" in p or re.search(f"[{LETTER}][.,]", p) for p in known):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return (f"\n|{SPACE}*[{LETTER}]+(?=[{SPACE}\n.,]|\\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def normalised(self, text):
        if self.library is not None:
            return self.library.normalize(text)
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def segment(self, text):
        """The ids of a normalised text by one pass of the automaton."""
        n = len(text)
        ends = [()] * n
        for end, piece in self.automaton.iter(text):
            if ends[end]:
                ends[end].append(piece)
            else:
                ends[end] = [piece]
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for end in range(n):
            top, step = None, None
            single = False
            for length, score, i in ends[end]:
                total = best[end + 1 - length] + score
                if top is None or total > top:
                    top, step = total, (length, i)
                single = length == 1
            if not single:
                total = best[end] + self.unknown_score
                if top is None or total > top:
                    top, step = total, (1, None)
            best[end + 1], back[end + 1] = top, step
        ids, at = [], n
        while at:
            length, i = back[at]
            at -= length
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids[::-1]

    def _ids(self, chunk):
        return np.array(self.segment(chunk), self.dtype).tobytes()

    def encode(self, texts):
        """The ids of each text as little-endian bytes; null is an empty text."""
        remembers(self)
        split = [self.chunk.findall(self.normalised(t)) if t else () for t in texts]
        new = set().union(*split)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        memo = self.memo
        for chunk in new:
            if chunk not in memo:
                memo[chunk] = self._ids(chunk)
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        for chunk in new:
            if len(chunk) > LONGEST_REMEMBERED:
                del memo[chunk]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        if not ids:
            return ""
        data = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        text = data.decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoder(path):
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path) -> DataFrame:
    """The rows of ``docs`` with all their columns, pieces (the ids of the whole text) and
    restored (whether the ids decode to the text), in the place of columns of these names
    if there are any. A null or empty text has no pieces; rows that repeat are encoded each,
    and no rows give no rows."""
    given = docs.drop("pieces", "restored")
    schema = StructType(given.schema.fields + [
        StructField("pieces", ArrayType(IntegerType())), StructField("restored", BooleanType())])
    arrow, text = to_arrow_schema(schema), given.columns.index("text")

    def encode(batches):
        model = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            for piece in chunks_of([batch], PIECE_BYTES):
                texts = piece.column(text).to_pylist()
                data = model.encode(texts)
                ids = np.frombuffer(b"".join(data), model.dtype).astype(np.int32)
                ends = np.cumsum([0, *(len(x) // model.dtype.itemsize for x in data)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                restored = [
                    model.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(data, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, lists, pa.array(restored, pa.bool_())], schema=arrow)

    return given.mapInArrow(encode, schema)


def decoded(coded: DataFrame, path) -> DataFrame:
    """The rows of ``coded`` (doc_id, pieces) as doc_id, n_pieces, ids_crc32 (of the ids as
    little-endian 32-bit integers) and decoded, the text that the ids spell."""
    def decode(batches):
        model = encoder(path)
        for batch in batches:
            rows = batch.column("pieces")
            lists = [np.asarray(x.values.to_numpy(), "<u4") for x in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(x) for x in lists], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64()),
                pa.array([model.decode(x.astype(model.dtype).tobytes()) for x in lists], pa.string()),
            ], ["doc_id", "n_pieces", "ids_crc32", "decoded"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "pieces").mapInArrow(
        decode, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded string")


def round_trip(docs: DataFrame, path) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256 (of the text the ids decode to) of
    every row of ``docs``: ``encoded`` and ``decoded`` in one task, without the lists in
    between. A text comes back as it was, but for the sign that stands for spaces, which
    becomes one; a null comes back empty. Rows that repeat come back each, and no rows give
    no rows."""
    def both(batches):
        model = encoder(path)
        for piece in chunks_of(batches, PIECE_BYTES):
            data = model.encode(piece.column("text").to_pylist())
            ids = [np.frombuffer(x, model.dtype) for x in data]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in data]),
            ], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        both, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string")
