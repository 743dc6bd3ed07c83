"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

# Settings the plans rely on.  Skewed shuffle joins are split at run time by adaptive execution;
# ``forceOptimizeSkewedJoin`` lets it do so even if a later operator then needs one more shuffle.
# The session's time zone is the user's: nothing here depends on it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sizes are those of compressed shuffle files, so look for skew early.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    # Before a stage has run, a table's size is that of its compressed files; the driver holds a broadcast
    # table as rows, some 30 times as large for keys and names.  Larger ones are joined on measured sizes.
    "spark.sql.sources.fileCompressionFactor": "32",
    # What one task sorts and aggregates, as compressed shuffle files; in memory it is over ten times that.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # What one task reads, as compressed files.  A task that deals rows to more than 200 partitions sorts them first,
    # and they too should fit in its memory.
    "spark.sql.files.maxPartitionBytes": "32m",
}

SHARED_FOLDER = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session, but for those its user has set."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


# Shuffles start with one partition per this many input bytes; adaptive execution merges small ones.
# A report deals several times its raw files, and what a task sorts should fit in its memory.
BYTES_PER_PARTITION = 8 * 1024 * 1024
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SIZED = "spark.cohortlens.sizedPartitions"


def partitions_for(size: int) -> int:
    """Partitions that a shuffle of ``size`` bytes starts with."""
    return -(-size // BYTES_PER_PARTITION)


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Let shuffles start with enough partitions for the data under ``folder``.

    A number the user has set is left alone.
    """
    ours, current = spark.conf.get(_SIZED, None), spark.conf.get(_INITIAL, None)
    if current is not None and current != ours:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = partitions_for(files.getContentSummary(path).getLength())
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(wanted))
        spark.conf.set(_SIZED, str(wanted))
    elif current is not None:
        spark.conf.unset(_INITIAL)
        spark.conf.unset(_SIZED)


def local_session(cores: int | str = "*", name: str = "cohortlens", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Test data is small; keep it on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"cohortlens-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may do without it.
    """
    folder = spark.conf.get(SHARED_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError(f"set {SHARED_FOLDER} to a folder that all executors can reach")
    return _own_folder(spark.sparkContext.applicationId)
