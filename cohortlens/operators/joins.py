"""Joining a fact table with a chain of dimension tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

Dimension = tuple[DataFrame, Sequence[str]]


def _is_small(df: DataFrame) -> bool:
    """Whether Spark knows the table to be small enough for a broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def join_dimensions(fact: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Inner join of ``fact`` with ``dimensions``, each given with the columns to join on.

    The first dimension meets the fact; the others may also meet one that comes before them.  If all
    are small the fact meets them one by one: Spark broadcasts each, and the fact is not shuffled at
    all.  Otherwise the dimensions meet each other first and the fact is shuffled once, not once per
    dimension.  The rows are the same either way.
    """
    (first, keys), *others = dimensions

    def chain(start: DataFrame) -> DataFrame:
        return reduce(lambda joined, d: joined.join(d[0], list(d[1])), others, start)

    if all(_is_small(df) for df, _ in dimensions):
        return chain(fact.join(first, list(keys)))
    return fact.join(chain(first), list(keys))
