"""Token ids in Arrow files of equal-length sequences with masks.

Documents are ordered by id, their ids follow each other without gaps, and every
partition becomes one Arrow file: record batches of fixed-size lists ``tokens`` and
``mask``. Any sequence is at a known place, so a reader maps the file and takes a
slice without copying. Only the last sequence of a file is padded (id 0, mask false).
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from querylume.llm.common import chunks_of, open_store, shared_folder, written
from querylume.llm.tokens import encoder

LENGTH = 2048
BATCH_SEQUENCES = 256
PIECE_BYTES = 4 << 20
MANIFEST = "part int, path string, n_tokens long, doc_ids array<long>, lengths array<int>"


class TokenWriter:
    """Appends ids to an Arrow file as whole sequences."""

    def __init__(self, sink, dtype, length=LENGTH):
        self.dtype, self.length = np.dtype(dtype), length
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([
            ("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def append(self, ids: bytes):
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * BATCH_SEQUENCES * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last):
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        step = self.length * (1 if last else BATCH_SEQUENCES)
        real = len(flat) if last else len(flat) // step * step
        taken, rest = flat[:real], flat[real:]
        padded = -(-real // self.length) * self.length
        mask = np.arange(padded) < real
        taken = np.concatenate([taken, np.zeros(padded - real, self.dtype)])
        size = self.length * BATCH_SEQUENCES
        for at in range(0, padded, size):
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(x[at:at + size]), self.length)
                for x in (taken, mask)
            ], schema=self.schema))
        self.held, self.n = [rest.tobytes()], len(rest) * self.dtype.itemsize

    def close(self):
        self._flush(True)
        self.out.close()


class TokenFile:
    """Random access to one file: nothing but the batches asked for is touched, and
    from a local file they are mapped, not copied."""

    def __init__(self, uri):
        store, path = open_store(uri)
        source = (
            pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        )
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("tokens").type.list_size

    def _flat(self, k, name):
        return self.reader.get_batch(k).column(name).values

    def sequence(self, i):
        """Ids and mask of the i-th sequence."""
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        row = i % BATCH_SEQUENCES
        return tuple(
            batch.column(name).values.slice(row * self.length, self.length)
            .to_numpy(zero_copy_only=False) for name in ("tokens", "mask")
        )

    def span(self, start, n):
        """``n`` ids from the ``start``-th on."""
        size, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            k, offset = divmod(start, size)
            part = self._flat(k, "tokens").slice(offset, n).to_numpy()
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.array([])


def _writing(folder, vocabulary, end_id, dtype, length):
    def write(batches):
        part = TaskContext.get().partitionId()
        out, sink, doc_ids, lengths = None, None, [], []
        encode = encoder(vocabulary, dtype).encode
        end = np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        for piece in chunks_of(batches, PIECE_BYTES):
            if out is None:
                store, path = open_store(folder)
                store.create_dir(path)
                name = f"{part:08d}-{uuid.uuid4().hex}.arrow"
                sink = store.open_output_stream(f"{path}/{name}")
                out = TokenWriter(sink, dtype, length)
            for ids in encode(piece.column("text").to_pylist()):
                out.append(ids + end)
                lengths.append(len(ids) // width + 1)
            doc_ids += piece.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"],
                "n_tokens": [sum(lengths)], "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
            })
    return write


def write_token_files(docs: DataFrame, vocabulary, end_id, dtype="<u2", length=LENGTH):
    """Encode ``docs`` (doc_id, text; more columns are ignored) and write the files.

    Returns the written manifest, one row per file: part (files in ascending doc_id
    order), path, n_tokens, and its documents with their lengths. A null text is empty,
    so every row has at least its end id; equal doc_ids follow each other by a hash of
    the text; a null doc_id comes first. Rows of one id, and repeated rows, are cut over
    several tasks like any others; for that the rows must come from a scan or a written
    table, which a repeated task reads in the same order. No rows, no files. A task that
    runs again writes a new file, and only the file of the attempt that counted is in the
    manifest.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    keys = ["doc_id", "spread", "place"]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("spread"),
                         F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    write = _writing(folder, vocabulary, end_id, dtype, length)
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _digests(batches):
    for batch in batches:
        for row in batch.to_pylist():
            file, at, sums = TokenFile(row["path"]), 0, []
            for n in row["lengths"]:
                sums.append(zlib.crc32(file.span(at, n).astype("<u4").tobytes()))
                at += n
            lengths = pa.array(row["lengths"], pa.int64())
            starts = pc.subtract(pc.add(pc.cumulative_sum(lengths), row["base"]), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), starts, lengths, pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens and the crc32 of its ids as little-endian 32-bit integers."""
    # One row per file: the running sum goes over counts, not over documents.
    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    bases = manifest.select("part", before.alias("base"))
    files = manifest.join(bases, "part").repartition(max(1, manifest.count()), "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return files.select("path", "base", "doc_ids", "lengths").mapInArrow(_digests, schema)
