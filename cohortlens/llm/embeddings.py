"""Near duplicates among embeddings: an epsilon grid order join.

Two unit vectors of cosine ``c`` are ``sqrt(2 - 2c)`` apart, so all pairs above a least cosine lie within a distance
epsilon.  The vectors are laid on a grid of that width on their leading principal axes and sorted by grid cell:
the epsilon grid order.  The sorted sequence is cut into blocks.  Blocks meet if they have cells next to each other and
their boxes are within epsilon; the sequences of two blocks are then joined by halving, and parts whose boxes
are further apart than epsilon are skipped.  Whatever remains is compared in double precision.

Projection never enlarges a distance, so nothing is skipped that could be a link.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.work import written


@dataclass(frozen=True)
class Grid:
    """Least cosine of a link, principal axes used, axes of the cells by which blocks meet, and vectors per
    block and per part that is compared at once."""

    cosine: float = 0.98
    axes: int = 8
    meeting: int = 3
    block: int = 1024
    leaf: int = 128

    @property
    def epsilon(self) -> float:
        return math.sqrt(2 - 2 * self.cosine) + 1e-6


def is_comparable(vector: Column, label: Column) -> Column:
    """Whether a vector can have links: a label, finite components, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & finite & some, F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square leaves the range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by dimension."""
    vectors = batch.column(column)
    sizes = vectors.value_lengths().to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(size), at, flat.astype(np.float64).reshape(len(at), size)


def _principal_axes(vectors: DataFrame, grid: Grid) -> dict[int, np.ndarray]:
    """For each dimension, the leading axes of the covariance of all unit vectors.

    The driver receives one number per pair of components, whatever the number of vectors.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, rows in _matrices(batch, 0):
                # a last component of one: its products are the sums and the count
                rows = np.hstack([unit(rows), np.ones((len(rows), 1))])
                sums[size] = sums.get(size, 0) + rows.T @ rows
        for size, total in sums.items():
            i, j = np.triu_indices(size + 1)
            columns = [np.full(len(i), size), i, j, total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "i", "j", "total"])

    found = vectors.select("vector").mapInArrow(moments, "size long, i long, j long, total double")
    found = found.groupBy("size", "i", "j").agg(F.sum("total").alias("total")).toArrow()
    sizes, i, j, values = (c.to_numpy() for c in found.columns)
    axes = {}
    for size in np.unique(sizes):
        here = sizes == size
        total = np.zeros((size + 1, size + 1))
        total[i[here], j[here]] = total[j[here], i[here]] = values[here]
        mean = total[:size, size] / total[size, size]
        spread, basis = np.linalg.eigh(total[:size, :size] / total[size, size] - np.outer(mean, mean))
        leading = np.argsort(spread)[::-1][: grid.axes]
        axes[int(size)] = basis[:, leading]
    return axes


def _ordered(classes: DataFrame, axes: dict[int, np.ndarray], grid: Grid) -> DataFrame:
    """The vectors in epsilon grid order: ``cells`` and ``place`` (coordinates on the axes) added."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, rows in _matrices(batch, 3):
                place = unit(rows) @ axes[size]
                cells = np.floor(place / grid.epsilon).astype(np.int32)
                part = batch.take(pa.array(at))
                part = part.append_column("size", pa.array(np.full(len(at), size, np.int32)))
                part = part.append_column("cells", pa.array(cells.tolist(), pa.list_(pa.int32())))
                yield part.append_column("place", pa.array(place.tolist(), pa.list_(pa.float64())))

    kind = dict(classes.dtypes)
    schema = f"node long, label {kind['label']}, many long, vector {kind['vector']}, size int, cells array<int>, place array<double>"
    found = classes.select("node", "label", "many", "vector").mapInArrow(project, schema)
    order = ["size", "label", "cells", "node"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


_BLOCK = [
    ("size", pa.int32()),
    ("nodes", pa.binary()),
    ("many", pa.binary()),
    ("vectors", pa.binary()),
    ("place", pa.binary()),
    ("low", pa.list_(pa.float64())),
    ("high", pa.list_(pa.float64())),
    ("cells", pa.list_(pa.list_(pa.int32()))),
]


def _blocks(ordered: DataFrame, grid: Grid) -> DataFrame:
    """Blocks of neighbours in the order, each with one label and dimension."""
    label = dict(ordered.dtypes)["label"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []

        def block(label: pa.DataType) -> pa.RecordBatch:
            first = waiting[0]
            place = np.array([r["place"] for r in waiting])
            cells = {tuple(r["cells"][: grid.meeting]) for r in waiting}
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "label": first["label"],
                        "size": first["size"],
                        "nodes": np.array([r["node"] for r in waiting], "<i8").tobytes(),
                        "many": np.array([r["many"] for r in waiting], "<i8").tobytes(),
                        "vectors": unit(np.array([r["vector"] for r in waiting], float)).astype("<f8").tobytes(),
                        "place": place.astype("<f8").tobytes(),
                        "low": place.min(axis=0).tolist(),
                        "high": place.max(axis=0).tolist(),
                        "cells": [list(c) for c in sorted(cells)],
                    }
                ],
                pa.schema([("label", label), *_BLOCK]),
            )

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("label").type
            for row in batch.to_pylist():
                same = waiting and (row["label"], row["size"]) == (waiting[0]["label"], waiting[0]["size"])
                if waiting and (not same or len(waiting) >= grid.block):
                    yield block(kind)
                    waiting.clear()
                waiting.append(row)
        if waiting:
            yield block(kind)

    cut_up = ordered.mapInArrow(
        cut,
        f"label {label}, size int, nodes binary, many binary, vectors binary, place binary, "
        "low array<double>, high array<double>, cells array<array<int>>",
    )
    return written(cut_up.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _block_pairs(blocks: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of blocks (``a`` <= ``b``) that may hold a link."""
    cells = blocks.select("block", "label", "size", F.explode("cells").alias("cell"))
    steps = list(itertools.product((-1, 0, 1), repeat=grid.meeting))
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    # Vectors of few dimensions have fewer axes: what a cell lacks, its neighbours lack too.
    near = F.transform(moves, lambda m: F.transform("cell", lambda c, i: c + F.get(m, i)))
    probes = cells.select(F.col("block").alias("a"), "label", "size", F.explode(F.array_distinct(near)).alias("cell"))
    met = probes.distinct().join(cells.withColumnRenamed("block", "b"), ["label", "size", "cell"])
    met = met.where("a <= b").select("a", "b").distinct()
    boxes = blocks.select("block", "low", "high")
    met = met.join(boxes.toDF("a", "low_a", "high_a"), "a").join(boxes.toDF("b", "low", "high"), "b")
    gaps = F.transform(
        F.arrays_zip("low_a", "high_a", "low", "high"),
        lambda g: F.greatest(g.getField("low") - g.getField("high_a"), g.getField("low_a") - g.getField("high"), F.lit(0.0)),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    return met.where(apart <= grid.epsilon**2).select("a", "b")


def _near_parts(place_a: np.ndarray, place_b: np.ndarray, same: bool, grid: Grid) -> Iterator[tuple[slice, slice]]:
    """Pairs of short sequence intervals whose boxes are within epsilon, by recursive halving."""
    open_ = [(0, len(place_a), 0, len(place_b))]
    while open_:
        a, a_end, b, b_end = open_.pop()
        if same and a >= b_end:
            continue  # the mirror image of a part that is looked at
        one, two = place_a[a:a_end], place_b[b:b_end]
        gap = np.maximum(two.min(axis=0) - one.max(axis=0), one.min(axis=0) - two.max(axis=0)).clip(0)
        if (gap * gap).sum() > grid.epsilon**2:
            continue
        if max(a_end - a, b_end - b) <= grid.leaf:
            yield slice(a, a_end), slice(b, b_end)
        elif a_end - a >= b_end - b:
            middle = (a + a_end) // 2
            open_ += [(a, middle, b, b_end), (middle, a_end, b, b_end)]
        else:
            middle = (b + b_end) // 2
            open_ += [(a, a_end, b, middle), (a, a_end, middle, b_end)]


def _links(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Lowest label reachable over a symmetric matrix of links, for each row."""
    while True:
        near = np.where(linked, labels[None, :], labels.max() + 1).min(axis=1)
        lower = np.minimum(labels, near)
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def compared(one: dict, two: dict, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks (or one with itself), the nodes with links between them, how many vectors each is linked
    with, and a node of its group here: links follow from these, without listing all pairs."""
    same = one["block"] == two["block"]

    def array(block: dict, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(block[name], kind)

    nodes_a, nodes_b = array(one, "nodes", "<i8"), array(two, "nodes", "<i8")
    many_a, many_b = array(one, "many", "<i8"), array(two, "many", "<i8")
    n, m = len(nodes_a), len(nodes_b)
    a = array(one, "vectors", "<f8").reshape(n, -1)
    b = array(two, "vectors", "<f8").reshape(m, -1)
    linked = np.zeros((n, m), bool)
    place_a = array(one, "place", "<f8").reshape(n, -1)
    place_b = array(two, "place", "<f8").reshape(m, -1)
    for rows, columns in _near_parts(place_a, place_b, same, grid):
        linked[rows, columns] = a[rows] @ b[columns].T >= grid.cosine
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
        counts, whole, nodes = linked @ many_a, linked, nodes_a
    else:
        counts = np.concatenate([linked @ many_b, many_a @ linked])
        whole = np.zeros((n + m, n + m), bool)
        whole[:n, n:], whole[n:, :n] = linked, linked.T
        nodes = np.concatenate([nodes_a, nodes_b])
    at = np.flatnonzero(counts)
    if not len(at):
        return nodes[at], counts[at], nodes[at]
    groups = _links(whole[np.ix_(at, at)], np.arange(len(at)))
    return nodes[at], counts[at], nodes[at][groups]


def _found(blocks: DataFrame, pairs: DataFrame, grid: Grid) -> DataFrame:
    """``node``, ``n`` and ``other`` of :func:`compared` for all pairs of blocks."""
    names = ["block", "nodes", "many", "vectors", "place"]
    left = blocks.select(*(F.col(c).alias(f"a_{c}") for c in names))
    right = blocks.select(*(F.col(c).alias(f"b_{c}") for c in names))
    rows = pairs.join(left, pairs.a == left.a_block).join(right, pairs.b == right.b_block).drop("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                one, two = ({c: row[f"{side}_{c}"] for c in names} for side in "ab")
                found = compared(one, two, grid)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "n", "other"])

    return rows.mapInArrow(compare, "node long, n long, other long")


def near_duplicates(
    df: DataFrame, grid: Grid | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row of ``df``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label and dimension are linked if their cosine is at least ``grid.cosine``.  Equal vectors
    are one class with a count.  Vectors that are null, zero, or hold null or non-finite components, and those
    without a label, have no links.  ``component_id`` is the smallest key that links reach, null keys
    counting only where there is no other; a row is kept if it bears that key.
    """
    grid = grid or Grid()
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good = is_comparable(F.col("vector"), F.col("label"))
    # Equal vectors may differ in the sign of a zero.
    rows = rows.withColumn("vector", F.when(good, F.transform("vector", lambda x: x + F.lit(0).cast("float"))))
    classes = rows.where("vector is not null").groupBy("label", "vector")
    classes = classes.agg(F.count("*").alias("many"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    blocks = _blocks(_ordered(classes, _principal_axes(classes, grid), grid), grid)
    found = written(_found(blocks, _block_pairs(blocks, grid), grid), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    tops = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    groups = classes.select("node", "first").join(tops, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node"))
    groups = written(groups, "groups")
    # Stored, so that the join may split a large component.
    lowest = written(groups.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    named = groups.join(lowest, "component").select("node", "lowest")
    answers = classes.join(counts, "node", "left").join(named, "node")
    answers = answers.select(
        "label",
        "vector",
        (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        "lowest",
        F.lit(True).alias("has"),
    )
    result = rows.join(answers, ["label", "vector"], "left")
    component = F.when(F.col("has"), F.col("lowest")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
