"""Running totals and ranks along an order, for groups of any size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import shared_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and every reader sees the same rows."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/stored-{application}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column | None = None,
    into: str = "before",
    row: str | None = None,
) -> DataFrame:
    """``df`` with ``into``: the total weight of the rows before, in the order of ``order`` within ``keys``.

    With the default weight of one that is the rank from 0.  Rows that are equal in ``order`` come in any, but one
    fixed order.  Nulls in ``keys`` are equal and come first in ``order``.  The weight is a whole number, null
    counting as 0.  ``row`` names a column that is different in every row, if there is one and ``df`` is a stored table;
    else the rows are stored first to be numbered.

    No group is gathered: the rows are split by range of (keys, order), each range totals its own rows, and the
    totals of the ranges before, one number per range and key, are put in front of each.  Copies of a row are dealt over
    ranges like any others.
    """
    weight = F.lit(1) if weight is None else weight
    keys, order = list(keys), list(order)
    names = ["_row", "_weight", "_range", "_at", into]
    if clash := {c for c in df.columns if c in names}:
        raise ValueError(f"columns {sorted(clash)} are used here")
    if row is None:
        df = stored(df, "rows").withColumn("_row", F.monotonically_increasing_id())
        row = "_row"
    by = [*keys, *order, *([row] if row not in order else [])]
    weighed = df.withColumn("_weight", F.coalesce(weight.cast("bigint"), F.lit(0)))
    ranged = weighed.repartitionByRange(*by).sortWithinPartitions(*by)
    # Stored, so that the totals and the rows are of the same ranges.
    ranged = stored(
        ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges"
    )
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_weight").alias("_weight"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_weight", F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
    # The total before a range is a row in front of it.
    rows = ranged.unionByName(bases.withColumn("_at", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    before = Window.partitionBy("_range", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn(into, F.sum("_weight").over(before)).where("_at >= 0")
    return found.select(*(c for c in df.columns if c != "_row"), into)
