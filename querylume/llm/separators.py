"""Documents of flat token files, found by their separator alone.

The files hold nothing but ids. Each is cut into blocks; every block is searched on its
own with one vectorised comparison, and what crosses block borders is stitched by a
prefix scan over one summary row per block.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from querylume.llm.common import chunks_of, open_store, shared_folder, written
from querylume.llm.tokens import encoder

BLOCK_TOKENS = 1 << 20
PIECE_BYTES = 4 << 20
MANIFEST = "path string, n_ids long, doc_ids array<long>"
BLOCKS = "path string, block long, n_ids long, ends array<long>"


def _writing(folder, vocabulary, separator, dtype):
    def write(batches):
        out, doc_ids, size = None, [], 0
        encode = encoder(vocabulary, dtype, special_as_text=True).encode
        end = np.array([separator], dtype).tobytes()
        for piece in chunks_of(batches, PIECE_BYTES):
            if out is None:
                store, path = open_store(folder)
                store.create_dir(path)
                name = f"{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(f"{path}/{name}")
            data = b"".join(ids + end for ids in encode(piece.column("text").to_pylist()))
            out.write(data)
            size += len(data)
            doc_ids += piece.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "n_ids": [size // len(end)],
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
            })
    return write


def write_flat_files(docs: DataFrame, vocabulary, separator, dtype="<u2") -> DataFrame:
    """One flat file of ids per input partition, the separator after every document.

    Returns the written list of files: path, n_ids, and the documents in file order. A
    null text is empty. Special tokens spelled out in a text are ordinary text, so the
    separator stands only where a document ends. No rows, no files.
    """
    folder = shared_folder(docs.sparkSession, "flat")
    write = _writing(folder, vocabulary, separator, dtype)
    return written(docs.select("doc_id", "text").mapInArrow(write, MANIFEST), "flat-manifest")


def _searching(separator, dtype):
    width = np.dtype(dtype).itemsize

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as file:
                    file.seek(row["first"] * width)
                    ids = np.frombuffer(file.read(row["n_ids"] * width), dtype)
                ends = np.flatnonzero(ids == separator) + row["first"]
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]], "block": [row["block"]], "n_ids": [len(ids)],
                    "ends": pa.array([ends], pa.list_(pa.int64())),
                })
    return search


def count_tokens(files: DataFrame, separator, dtype="<u2", block=BLOCK_TOKENS) -> DataFrame:
    """Documents of flat token files: path, ordinal (from 0 in the file), start, n_tokens
    (without the separator) and ended.

    ``files`` has path and n_ids; more columns are ignored. Two separators in a row
    enclose an empty document. Ids after the last separator are a document with ended
    false; a file of no ids has none.
    """
    first = F.col("block") * block
    blocks = (
        files.select("path", F.col("n_ids").alias("total"))
        .filter("total > 0")
        .select("path", "total", F.explode(
            F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {block}"))).alias("block"))
        .select("path", "block", first.alias("first"),
                F.least(F.lit(block), F.col("total") - first).alias("n_ids"))
        .repartition("path", "block")
    )
    found = written(blocks.mapInArrow(_searching(separator, dtype), BLOCKS), "separators")
    # The scan: per block, how many documents ended before it and where the last of them did.
    earlier = Window.partitionBy("path").orderBy("block")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select(
        "path", "block", "n_ids", F.size("ends").alias("n_ends"),
        F.try_element_at("ends", F.lit(-1)).alias("last"),
    )
    scanned = marks.select(
        "path", "block",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal_base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open_since"),
    )
    ended = (
        found.join(scanned, ["path", "block"])
        .select("path", "ordinal_base", F.arrays_zip(
            F.expr("slice(concat(array(open_since), ends), 1, size(ends))").alias("since"),
            F.col("ends").alias("at")).alias("spans"))
        .select("path", "ordinal_base", F.posexplode("spans").alias("i", "span"))
        .select("path", (F.col("ordinal_base") + F.col("i")).alias("ordinal"),
                (F.col("span.since") + 1).alias("start"),
                (F.col("span.at") - F.col("span.since") - 1).alias("n_tokens"),
                F.lit(True).alias("ended"))
    )
    tails = (
        marks.groupBy("path").agg(F.sum("n_ends").alias("ordinal"), F.sum("n_ids").alias("n"),
                                  F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
        .select("path", "ordinal", (F.col("last") + 1).alias("start"),
                (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
        .filter("n_tokens > 0")
    )
    return ended.unionByName(tails)
