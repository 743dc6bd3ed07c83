"""Packing of token sequences by vector best fit.

A document's ids, closed by an end id, are cut into pieces of at most one sequence.  Pieces are dealt
at random into groups of bounded size, and every group is packed by itself: its pieces in order of
falling length, each into the open sequence that fits best under all capacities together: tokens,
pieces and attention cost (the sum of squared lengths).  A group wastes at most its last few sequences,
so thousands of pieces a group cost next to nothing, and any number of groups run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.work import unused, written

#: Pieces that are packed together, on average.
GROUP = 8192


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how much each resource weighs in the choice of a sequence.

    The defaults of ``pieces`` and ``attention`` are what a full sequence can reach, so that only tokens
    bind; lower values bound the documents mixed in a sequence and the cost of attending to them.
    """

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def pieces(df: DataFrame, ids: str = "ids", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Replace binary ``ids`` by one row per piece: ``piece``, ``start``, ``length``, ``ids``.

    Each document's ids are followed by ``end_id``; null ids count as none, so that such a document is
    one piece that holds the end id alone.  Only documents longer than ``size`` are cut.  Other columns
    are carried; those named like a new one are replaced.
    """
    end = F.lit(end_id.to_bytes(4, "little"))
    whole = F.concat(F.coalesce(F.col(ids), F.lit(b"")), end)

    def cut(ids: Column) -> Column:
        n = (F.octet_length(ids) / 4).cast("bigint")
        places = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
        return F.transform(
            places,
            lambda i: F.struct(
                i.alias("piece"),
                (i.cast("bigint") * size).alias("start"),
                F.least(F.lit(size), n - i.cast("bigint") * size).alias("length"),
                F.substring(ids, i * (4 * size) + 1, F.lit(4 * size)).alias("ids"),
            ),
        )

    rest = [c for c in df.columns if c not in (ids, "piece", "start", "length", "ids")]
    found = F.get(F.transform(F.array(whole), cut), F.lit(0))
    return df.select(*(F.col(f"`{c}`") for c in rest), F.explode(found).alias("_cut")).select(
        *(F.col(f"`{c}`") for c in rest), "_cut.*"
    )


def best_fit(lengths, capacity: Capacity, score: str = "norm"):
    """Bin and offset of every piece; the pieces must come in the order of placement.

    ``norm`` takes the open sequence whose weighted residual after the piece is shortest, ``dot`` the one
    whose residual has the largest weighted product with the piece; the earliest on a tie.  A piece
    that breaks a limit by itself has a sequence of its own.
    """
    import numpy as np

    caps = np.array([capacity.tokens, capacity.pieces, capacity.attention], float)
    weights = np.array(capacity.weights, float)
    n = len(lengths)
    left = np.empty((3, n))  # residuals of the open sequences, as a share of the capacity
    names = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    is_open = made = 0
    lengths = np.asarray(lengths, np.int64)
    smallest = lengths.min() if n else 0
    edge = 1e-12
    for k in range(n):
        size = int(lengths[k])
        item = np.array([size, 1, size * size]) / caps
        at = -1
        if is_open:
            after = left[:, :is_open] - item[:, None]
            fits = (after >= -edge).all(axis=0)
            if fits.any():
                if score == "norm":
                    rank = np.where(fits, weights @ (after * after), np.inf)
                else:
                    rank = np.where(fits, -((weights * item) @ left[:, :is_open]), np.inf)
                at = int(rank.argmin())
        if at < 0:
            at, is_open = is_open, is_open + 1
            left[:, at], names[at], used[made] = 1.0, made, 0
            made += 1
        name = names[at]
        bins[k], offsets[k] = name, used[name]
        used[name] += size
        left[:, at] -= item
        # Nothing that is left to place can join a sequence with less room than the smallest piece.
        if (left[:, at] < np.array([smallest, 1, smallest * smallest]) / caps - edge).any():
            is_open -= 1
            left[:, at], names[at] = left[:, is_open], names[is_open]
    return bins, offsets


def packed(
    df: DataFrame,
    capacity: Capacity | None = None,
    length: str = "length",
    score: str = "norm",
    group: int = GROUP,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to rows that each hold a piece of ``length`` tokens.

    Every row is placed once and the pieces of a sequence stand side by side from offset 0.  Rows with
    a null or negative length count as empty.  Rows are dealt by their place in the stored input, not by
    a value, so that equal or null keys are no heavier than others.  Columns of ``df`` named like a new
    one are replaced.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"no such score: {score}")
    capacity = capacity or Capacity()
    df = df.drop("sequence_id", "offset")
    rows = written(df, "pieces")
    groups = max(1, math.ceil(rows.count() / group))
    row, dealt = unused(rows, "_row"), unused(rows, "_group")
    rows = rows.withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn(dealt, F.pmod(F.xxhash64(row), F.lit(groups)))

    def place(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        sizes = table[length].to_numpy().astype(float)
        sizes = np.nan_to_num(sizes, nan=0.0).clip(0).astype(np.int64)
        order = np.lexsort((table[row].to_numpy(), -sizes))
        bins, offsets = best_fit(sizes[order], capacity, score)
        table = table.take(pa.array(order)).drop_columns([row, dealt])
        base = int(key[0].as_py()) << 32
        table = table.append_column("sequence_id", pa.array(bins + base, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return rows.groupBy(dealt).applyInArrow(place, T.StructType([*df.schema.fields, *added]))
