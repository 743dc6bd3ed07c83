"""Bring parents and children together: as flat rows, or as lists of bounded length.

A parent's list may hold any share of all rows, so it is delivered in *parts*: one row per
(parent, part) whose lists hold about ``part_size`` elements.  Parts are numbered from 0 without gaps, most parents
have the single part 0, and the parts in order are the whole sorted list: neither its elements nor their order
depend on ``part_size``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ranking import running, stored

PART_SIZE = 10_000


def split_copies(rows: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Cut a number of ``copies`` beyond ``part_size`` into several rows, told apart by ``piece``."""
    pieces = F.sequence(F.lit(0), ((F.col("copies") - 1) / part_size).cast("int"))
    left = F.col("copies") - F.col("piece").cast("bigint") * part_size
    return rows.withColumn("piece", F.explode(pieces)).withColumn(
        "copies", F.least(left, F.lit(part_size))
    )


def _has_list(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_list(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType)


def _plain(name: str, kind: T.DataType) -> Column:
    """What an element is sorted by: all of it but the lists it holds."""
    if not isinstance(kind, T.StructType) or not _has_list(kind):
        return F.col(name)
    kept = [F.col(f"{name}.{f.name}") for f in kind.fields if not _has_list(f.dataType)]
    return F.when(F.col(name).isNotNull(), F.struct(*kept))


def collect_parts(
    rows: DataFrame,
    keys: Sequence[str],
    lists: Mapping[str, Column],
    ties: Sequence[str] = (),
    *,
    copies: str | None = None,
    weight: Column | None = None,
    parents: DataFrame | None = None,
    census: DataFrame | None = None,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """One row per (``keys``, part) with a sorted list per entry of ``lists``.

    ``lists`` maps a list name to the element a row contributes, or null for none; a row contributes to one
    list.  Elements are sorted by their plain fields, then by the columns ``ties``, then by a hash of the lists they hold.
    ``copies`` names a column with the number of times to repeat the element; ``weight`` is the size of an
    element that itself holds lists.  ``parents`` adds empty parts, so that :func:`attach_parts` finds every parent.
    ``census`` is a cheaper DataFrame of ``keys`` and ``weight`` from which to tell the large parents; it only
    steers the work.

    Parents of at most ``part_size`` are grouped as they are.  The elements of the others are ranked over sorted
    ranges, whoever they belong to, and cut by rank; that gives the same order.
    """
    keys = list(keys)
    if weight is None:
        weight = F.col(copies) if copies else F.lit(1)
    elements = rows.select(
        *keys,
        *(e.alias(n) for n, e in lists.items()),
        *([F.col(copies).cast("int").alias("_copies")] if copies else []),
        # No element fills more than a part, so that no part is left out.
        F.least(weight.cast("bigint"), F.lit(part_size)).alias("_size"),
        *(F.col(c).alias(f"_tie_{i}") for i, c in enumerate(ties)),
    )
    kinds = {n: elements.schema[n].dataType for n in lists}
    if parents is not None:
        blank = parents.select(*keys, F.lit(0).cast("bigint").alias("_size"))
        elements = elements.unionByName(blank, allowMissingColumns=True)
    holds = [n for n, kind in kinds.items() if _has_list(kind)]
    order = {f"_{n}": _plain(n, kind) for n, kind in kinds.items()}
    order |= {f"_tie_{i}": F.col(f"_tie_{i}") for i in range(len(ties))}
    if holds:
        order["_hash"] = F.xxhash64(*holds)

    def gathered(name: str, place: Column | None) -> Column:
        """The list of one part; elements without lists sort themselves."""
        element = F.col(name)
        if copies:
            element = F.when(element.isNotNull(), F.array_repeat(element, F.col("_copies")))
        if place is None and name not in holds:
            found = F.sort_array(F.collect_list(element))
        else:
            place = F.struct(*(c.alias(k) for k, c in order.items())) if place is None else place
            placed = F.when(F.col(name).isNotNull(), F.struct(place.alias("place"), element.alias("element")))
            found = F.transform(F.sort_array(F.collect_list(placed)), lambda x: x["element"])
        return (F.flatten(found) if copies else found).alias(name)

    def grouped(df: DataFrame, by: list[str], place: Column | None) -> DataFrame:
        return df.groupBy(*by).agg(
            *(gathered(n, place) for n in lists), F.sum("_size").alias("part_weight")
        )

    counted = elements.withColumnRenamed("_size", "weight") if census is None else census
    hot = counted.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum("weight").alias("_total"))
    hot = stored(hot.where(F.col("_total") > part_size).drop("_total"), "large-parents")
    none = F.lit(0).cast("bigint").alias("part")
    shown = [*keys, "part", *lists, "part_weight"]
    if hot.isEmpty():
        return grouped(elements, keys, None).withColumn("part", none).select(*shown)
    elements = stored(elements, "elements").withColumn("_element", F.monotonically_increasing_id())
    large = [elements[k].eqNullSafe(hot[f"_{k}"]) for k in keys]
    small = grouped(elements.join(hot, large, "left_anti"), keys, None).withColumn("part", none)

    # Only the sorted fields are ranked; the elements meet their rank afterwards.
    spread = elements.join(hot, large, "left_semi")
    # Which list an element is of comes first.
    which = F.coalesce(*(F.when(F.col(n).isNotNull(), i) for i, n in enumerate(lists)), F.lit(-1)).alias("_list")
    slim = spread.select("_element", *keys, "_size", which, *(c.alias(k) for k, c in order.items()))
    ranked = running(slim, keys, ["_list", *order], F.col("_size"), "_before", row="_element")
    ranked = ranked.select("_element", "_before")
    cut = spread.join(ranked, "_element").withColumn("part", F.floor(F.col("_before") / part_size))
    return small.select(*shown).unionByName(grouped(cut, [*keys, "part"], F.col("_before")).select(*shown))


def attach_parts(parents: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join each parent with its parts; a parent in several parts becomes several rows.

    The join is inner, so adaptive execution may split a large parent's parts over several tasks;
    null keys find the empty part made for them.
    """
    renamed = parts.withColumnsRenamed({k: f"_{k}" for k in keys})
    matched = [parents[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return parents.join(renamed, matched).drop(*(f"_{k}" for k in keys))


def expand(
    parents: DataFrame, children: DataFrame, keys: Sequence[str], among: DataFrame | None = None
) -> DataFrame:
    """Left join of parents with their children, for parents with any share of the children.

    A left join cannot split a large parent's children over tasks; an inner join can.  So the match is
    an inner join, and the parents without children are added.  ``among`` is a cheaper DataFrame with
    the same ``keys`` as the children.
    """
    keys = list(keys)
    known = children if among is None else among
    childless = parents.join(known.select(*keys).distinct(), keys, "left_anti")
    return parents.join(children, keys).unionByName(childless, allowMissingColumns=True)


def record(contract: T.StructType, **renamed: Column) -> Column:
    """A struct of the contract's fields, from like-named columns or from ``renamed``."""
    return F.struct(*(renamed.get(n, F.col(n)).alias(n) for n in contract.names))


def prefixed(prefix: str, contract: T.StructType, skip: Sequence[str] = (), **renamed: Column):
    """The contract's fields as typed columns ``<prefix>_<field>``, from like-named columns."""
    return [
        renamed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f"{prefix}_{f.name}")
        for f in contract.fields
        if f.name not in skip
    ]
