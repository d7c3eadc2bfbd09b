"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from cliploom.operators.sizing import in_bytes

# Settings that hold at any size. Memory, cores and the number of shuffle
# partitions belong to the cluster, so they are left to spark-submit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording the call site of every Column call makes building long expressions slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "cliploom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


BYTES_PER_PARTITION = 128 << 20


def size_shuffles(spark: SparkSession, shuffled_bytes: int) -> int:
    """Set the number of shuffle partitions for an amount of data, at least one per core.

    Adaptive execution joins partitions that turn out small, and cannot split those that
    a plain sort or aggregate leaves too large: aim high.
    """
    partitions = max(spark.sparkContext.defaultParallelism, -(-shuffled_bytes // BYTES_PER_PARTITION))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


ROWS_PER_BATCH = 1_000  # rows that Spark hands to Python at once, at most; they may be frames, long texts or packed blocks,
BYTES_PER_BATCH = 8 << 20  # so it stops at about as many bytes, outside the heap and once more in Python


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, in rows and in bytes: what a worker holds does not grow with its task or with the frames."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_PER_BATCH:
        spark.conf.set(setting, ROWS_PER_BATCH)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if in_bytes(spark.conf.get(setting)) > BYTES_PER_BATCH:
        spark.conf.set(setting, BYTES_PER_BATCH)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package, as ``spark-submit --py-files`` would, and bound their batches.

    The archive is made on the driver; Spark copies it to every executor, later ones too.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="cliploom-")) / package.name
        sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    It is whatever ``spark.checkpoint.dir`` names. Only a local master, where one
    machine is the whole cluster, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cliploom-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder. ``drop_scratch`` removes what was written to such paths."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _scratch.add(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables of this process; results that were not evaluated yet can no longer be. Returns their number."""
    conf, dropped = spark._jsc.hadoopConfiguration(), 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        dropped += path.getFileSystem(conf).delete(path, True)
    return dropped
