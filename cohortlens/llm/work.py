"""Intermediate tables in the shared folder, and column names that cannot clash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import shared_folder


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; it belongs to this application."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/corpus-{application}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a stored table: its lineage ends there, and every reader sees the same rows."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    paths = {file.rpartition("/")[0] for file in df.inputFiles()}
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What a task hands its Python worker at once.  Spark's own bound is 64 MB or 10,000 rows: a whole split of documents,
#: held by the JVM, in buffers that grow by doubling, and by the worker, for every task that runs.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Let Python workers receive documents in batches of few megabytes, unless the user has set a size."""
    key, size = BATCH
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
