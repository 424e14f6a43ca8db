"""What several operators share: written intermediate tables, files in the shared folder."""

import gc

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from querylume.session import scratch_path


def written(df, label):
    """``df`` written to the shared folder and read again: lineage ends here, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def dropped(spark, *tables):
    """Delete written tables nothing reads any more, and let Spark's cleaner remove the
    shuffle files of finished jobs."""
    for table in tables:
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            conf = spark._jsc.hadoopConfiguration()
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
    gc.collect()
    spark._jvm.System.gc()


def shared_folder(spark, label):
    """A fresh folder below the shared one for files of the library's own formats; made
    by the tasks that write into it."""
    return scratch_path(spark, label)


def open_store(uri):
    """The file system of ``uri`` as tasks see it, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def text_key():
    """128 bits of a document's text; those of a null are apart from those of an empty one."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))


def keyed(docs, *columns):
    """Documents with an integer doc_id by ``dk`` and ``tk``, which tell apart all rows that
    differ in id or text, and sort them: rows without an id come after all others and are
    apart from those with the largest one."""
    mark = F.when(F.col("doc_id").isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("dk"),
        F.concat(mark, text_key()).alias("tk"), "text", *columns)


KEY = ["dk", "tk"]


def utf8_lengths(column):
    """Bytes of each text in an Arrow string column, null as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def chunks_of(batches, max_bytes):
    """Arrow batches with a ``text`` column, cut so that one piece holds about
    ``max_bytes`` of text, or a single longer row. Rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = utf8_lengths(batch.column("text")).cumsum()
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(total.searchsorted(before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


_REMEMBERING = []


def remembers(owner=None):
    """Say that ``owner`` now uses its memory of words in this worker, or that no operator
    does. Workers outlive their tasks: what another operator remembers is forgotten, and
    freed memory goes back, so that memories do not add up."""
    if _REMEMBERING and _REMEMBERING[0] is owner:
        return
    if _REMEMBERING:
        _REMEMBERING.pop().memo.clear()
    if owner is not None:
        _REMEMBERING.append(owner)
    pa.default_memory_pool().release_unused()
