"""Parquet writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import BUCKET, bucket_of
from cohortlens.schemas import INPUTS, PROGRAMME_COLUMN

ROWS_PER_FILE = 5_000_000


def write_report(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a report; rows stay where they were computed, so a large programme has many files."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_tables(tables, root: str, only: Iterable[str] = tuple(INPUTS)) -> None:
    """Materialise input tables as ``<root>/<TableName>``, to be read by ``parquet_tables``."""
    for key in only:
        write_report(getattr(tables, key), f"{root.rstrip('/')}/{INPUTS[key][0]}")


def write_by_programme(tables, root: str, only: Iterable[str], mode: str = "errorifexists") -> None:
    """Like :func:`write_tables`, in folders by a hash of the programme, for reading one programme alone.

    Rows are sorted by range of (folder, programme, user), so a programme with a third of all rows is written by many
    tasks and a small one lies in few files.
    """
    for key in only:
        df = getattr(tables, key)
        column = PROGRAMME_COLUMN[key]
        order = [BUCKET, column, *(["user_id"] if "user_id" in df.columns else [])]
        sorted_ = df.withColumn(BUCKET, bucket_of(F.col(column))).repartitionByRange(*order).sortWithinPartitions(*order)
        write_report(sorted_, f"{root.rstrip('/')}/{INPUTS[key][0]}", [BUCKET], mode)


def write_documents(df: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists") -> None:
    """Write documents that come in parts, with a manifest: per document its parts and the elements of each list.

    ``keys`` tell the documents apart and ``part`` numbers the parts of one from 0.
    """
    root = path.rstrip("/")
    write_report(df, f"{root}/parts", mode=mode)
    parts = df.sparkSession.read.schema(df.schema).parquet(f"{root}/parts")
    write_report(_manifest(parts, keys), f"{root}/manifest", mode=mode)


def _manifest(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    lists = [f.name for f in parts.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return parts.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.countDistinct("part").alias("parts"),
        (F.max("part") + 1).alias("last_part"),
        *(F.sum(F.coalesce(F.size(n), F.lit(0))).alias(f"n_{n}") for n in lists),
    )


def read_documents(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The documents that :func:`write_documents` wrote; an error if a part of one is missing or repeated."""
    root = path.rstrip("/")
    parts, manifest = spark.read.parquet(f"{root}/parts"), spark.read.parquet(f"{root}/manifest")
    found = _manifest(parts, keys)
    # Both sides have the same columns, so what differs is in one but not in the other.
    wrong = manifest.exceptAll(found.select(manifest.columns)).unionAll(found.select(manifest.columns).exceptAll(manifest))
    some = wrong.select(*keys).distinct().limit(10).toArrow().to_pylist()
    if some:
        raise ValueError(f"documents do not match their manifest: {some}")
    gaps = manifest.where("parts <> last_part").select(*keys).limit(10).toArrow().to_pylist()
    if gaps:
        raise ValueError(f"documents lack parts: {gaps}")
    return parts
