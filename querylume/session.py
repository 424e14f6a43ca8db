"""Session settings and the shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app="querylume", master=None, shuffle_partitions=None, **conf):
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit
    names the master, and the number of shuffle partitions belongs to the size of
    the data (AQE merges small ones, so err on the high side).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Shuffle joins whose measured build side is small per task need no sort.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # Streaming state on the executors' disks instead of their heaps.
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
            )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_DIRS = {}


def shared_dir(spark):
    """The folder every executor can reach, named by ``spark.checkpoint.dir``. Only in
    local mode may it be unset; a temporary folder stands in then."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="querylume-")
    return _LOCAL_DIRS[app]


def scratch_path(spark, label):
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/querylume-{label}-{uuid.uuid4().hex}"
