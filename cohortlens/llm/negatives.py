"""Hard negatives by a multiway hyperplane tree.

Every node of the tree has a few split points; a row belongs to the nearest one, so that hyperplanes part the children.
Each split point stores the least and largest distance to the rows of every child beside it.  A search for scores in
a window (inner products with an anchor) is a search for distances in a ring around the anchor, as
``|a - x|^2 = |a|^2 + |x|^2 - 2 a.x``; a child is left out where, by any split point's range, the ring can't meet it.
The rows of the leaves lie in blocks, and what is not left out is compared in full.

A search has two rounds.  The first looks into one leaf per window, the one whose point lies nearest to the ring's inner
edge, and so learns a score that enough rows reach; that narrows the ring for the second round, which decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.work import written


@dataclass(frozen=True)
class Shape:
    """Split points of a node, rows a leaf should hold, leaves at most (then leaves grow), vectors at most that the
    split points are chosen from and components these may have together, rows of a block, and anchors of a block."""

    degree: int = 12
    leaf: int = 2048
    most: int = 8192
    sample: int = 16_384
    components: int = 1 << 22
    block: int = 2048
    anchors: int = 256


@dataclass
class Split:
    points: np.ndarray
    children: list  # Split, or the number of a leaf
    #: Least and largest distance of child j's rows to split point i, and least and largest square of their lengths.
    near: np.ndarray = field(default=None)
    far: np.ndarray = field(default=None)
    norms: np.ndarray = field(default=None)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(squares.clip(0))


class Tree:
    """Split points from a sample; ranges are added when all rows are in their leaves."""

    def __init__(self, sample: np.ndarray, rows: int, shape: Shape):
        self.shape, self.leaves, self.points = shape, 0, []
        wanted = min(shape.most, max(1, -(-rows // shape.leaf)))
        self.root = self._split(sample, wanted)

    def _split(self, sample: np.ndarray, wanted: int):
        """A node for ``sample`` with about ``wanted`` leaves below."""
        if wanted > 1 and len(sample):
            picked = [0]
            gap = _distances(sample, sample[:1])[:, 0]
            while len(picked) < min(self.shape.degree, max(2, wanted)) and gap.max() > 0:
                # The point farthest from those picked before.
                picked.append(int(gap.argmax()))
                gap = np.minimum(gap, _distances(sample, sample[picked[-1:]])[:, 0])
            if len(picked) > 1:
                points = sample[picked]
                own = _distances(sample, points).argmin(axis=1)
                shares = np.bincount(own, minlength=len(points)) / len(sample)
                children = []
                for k, share in enumerate(shares):
                    inside = sample[own == k]
                    part = wanted * share
                    if part >= 2 and len(inside) > 2 * self.shape.degree:
                        children.append(self._split(inside, round(part)))
                    else:
                        children.append(self._leaf(points[k]))
                return Split(points, children)
        return self._leaf(sample[0] if len(sample) else np.zeros(sample.shape[1]))

    def _leaf(self, point: np.ndarray) -> int:
        self.points.append(point)
        self.leaves += 1
        return self.leaves - 1

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not isinstance(node, Split):
                found[at] = node
            elif len(at):
                own = _distances(rows[at], node.points).argmin(axis=1)
                todo += [(child, at[own == k]) for k, child in enumerate(node.children)]
        return found

    def path(self, leaf: int) -> list[Split]:
        """The nodes above a leaf, from the root."""

        def walk(node) -> list[Split] | None:
            if not isinstance(node, Split):
                return [] if node == leaf else None
            for child in node.children:
                below = walk(child)
                if below is not None:
                    return [node, *below]
            return None

        return walk(self.root) or []

    def ranges(self, leaf: int, rows: np.ndarray) -> list[float]:
        """Least and largest square of length, then least and largest distance to every split point above."""
        squares = (rows * rows).sum(axis=1)
        found = [squares.min(), squares.max()]
        for node in self.path(leaf):
            gaps = _distances(rows, node.points)
            for least, most in zip(gaps.min(axis=0), gaps.max(axis=0), strict=True):
                found += [least, most]
        return [float(x) for x in found]

    def store(self, by_leaf: dict[int, np.ndarray]) -> None:
        """Fold the ranges of the leaves, as of :meth:`ranges`, into those of all nodes."""

        def fold(node, depth: int) -> dict:
            """Per depth above: (least, most) of the node's rows; None where it has none."""
            if not isinstance(node, Split):
                return {"ranges": by_leaf.get(node)}
            k = len(node.points)
            node.near, node.far = np.full((k, k), np.inf), np.full((k, k), -np.inf)
            node.norms = np.tile([np.inf, -np.inf], (k, 1))
            whole = None
            for j, child in enumerate(node.children):
                found = fold(child, depth + 2 * k)["ranges"]
                if found is None:
                    continue
                node.norms[j] = found[:2]
                mine = found[depth : depth + 2 * k]
                node.near[:, j], node.far[:, j] = mine[0::2], mine[1::2]
                above = found[:depth]
                if whole is None:
                    whole = above.copy()
                else:
                    whole[0::2] = np.minimum(whole[0::2], above[0::2])
                    whole[1::2] = np.maximum(whole[1::2], above[1::2])
            return {"ranges": whole}

        fold(self.root, 2)

    def met(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that can hold scores between ``low`` and ``high``, with the rows these are asked for."""
        squares = (rows * rows).sum(axis=1)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if not isinstance(node, Split):
                yield node, at
                continue
            gaps = _distances(rows[at], node.points)
            for j, child in enumerate(node.children):
                if node.norms[j, 0] > node.norms[j, 1]:
                    continue  # no rows
                inner, outer = ring(squares[at], node.norms[j], low[at], high[at])
                can = meets(gaps, node.near[:, j], node.far[:, j], inner, outer)
                todo.append((child, at[can]))

    def nearest_to(self, rows: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per row the leaf whose point lies nearest to the inner edge of the ring for scores up to ``high``."""
        points = np.array(self.points)
        found = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), 256):
            gaps = _distances(rows[at : at + 256], points)
            squares = (rows[at : at + 256] ** 2).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :]
            edge = np.sqrt(np.where(np.isinf(high[at : at + 256, None]), 0, squares - 2 * high[at : at + 256, None]).clip(0))
            found[at : at + 256] = np.abs(gaps - edge).argmin(axis=1)
        return found


def ring(squares: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer distance at which rows of squared lengths in ``norms`` can have scores in the window; the
    outer one is negative where none can."""
    inner = np.sqrt((squares + norms[0] - 2 * high).clip(0))
    outer = squares + norms[1] - 2 * low
    return inner, np.where(outer < 0, -1.0, np.sqrt(outer.clip(0)))


def meets(gaps: np.ndarray, near: np.ndarray, far: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether rows at ``near`` to ``far`` from each split point can lie in the rings of those at ``gaps``."""
    slack = 1e-6 * (1 + gaps.max(axis=1))
    least = np.maximum(gaps - far, near - gaps).max(axis=1)
    most = (gaps + far).min(axis=1)
    return (least <= outer + slack) & (most >= inner - slack) & (outer >= 0)


def _is_usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite, F.lit(False))


def _padded(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """Vectors of a batch as rows of ``size`` components; what a vector lacks is 0."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(batch), size))
    found[np.arange(size)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return found


def _fitted(rows: DataFrame, count: int, size: int, shape: Shape) -> Tree:
    """Split points from at most ``shape.sample`` vectors, and ``shape.components`` numbers, drawn by hash."""
    most = max(1, min(shape.sample, shape.components // max(1, size)))
    drawn = rows.select("vector")
    if count > most:
        share = int(most / count * (1 << 30))
        drawn = drawn.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) <= share)
    found = drawn.limit(most).toArrow()
    sample = np.zeros((found.num_rows, size))
    at = 0
    for batch in found.to_batches():
        sample[at : at + len(batch)] = _padded(batch, 0, size)
        at += len(batch)
    return Tree(sample, count, shape)


def _blocks(rows: DataFrame, tree: Tree, size: int, length: int, by_leaf: bool, label: str) -> DataFrame:
    """Rows in blocks of at most ``length``, sorted by leaf and id: ``leaf``, ``ids``, ``labels``, ``vectors``, ``ranges``.

    With ``by_leaf`` a block has rows of one leaf, and ``ranges`` as of :meth:`Tree.ranges`.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _padded(batch, 2, size)
            leaf = pa.array(shared.value.leaf_of(vectors))
            packed = pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), leaf, packed], ["id", "label", "leaf", "vector"])

    placed = rows.select("id", "label", "vector").mapInArrow(place, f"id long, label {label}, leaf long, vector binary")
    placed = placed.repartitionByRange("leaf", "id", F.xxhash64("vector")).sortWithinPartitions("leaf", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, []  # slices of arrived batches that make one block
        paths: dict[int, list] = {}

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vectors = b"".join(table["vector"].to_pylist())
            leaf = table["leaf"][0].as_py()
            ranges = shared.value.ranges(leaf, np.frombuffer(vectors, "<f8").reshape(-1, size)) if by_leaf and size else []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([leaf], pa.int64()),
                    pa.array([table["id"].to_numpy()], pa.list_(pa.int64())),
                    pa.array([table["label"].to_pylist()], pa.list_(kind)),
                    pa.array([vectors], pa.binary()),
                    pa.array([ranges], pa.list_(pa.float64())),
                ],
                ["leaf", "ids", "labels", "vectors", "ranges"],
            )

        for batch in batches:
            kind = batch.schema.field("label").type
            leaves = batch.column(2).to_numpy()
            at = 0
            while at < len(batch):
                if held and by_leaf and held[0].column(2)[0].as_py() != leaves[at]:
                    yield block()
                room = length - sum(map(len, held))
                end = min(len(batch), at + room)
                if by_leaf:
                    end = min(end, int(np.searchsorted(leaves, leaves[at], "right")))
                held.append(batch.slice(at, end - at))
                at = end
                if sum(map(len, held)) >= length:
                    yield block()
        if held:
            yield block()

    found = placed.mapInArrow(cut, f"leaf long, ids array<long>, labels array<{label}>, vectors binary, ranges array<double>")
    return written(found.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _with_ranges(tree: Tree, blocks: DataFrame) -> Tree:
    """The tree with the ranges of all rows; the driver receives two numbers per leaf and split point above it."""
    places = blocks.select("leaf", F.posexplode("ranges").alias("at", "x"))
    found = places.groupBy("leaf", "at").agg(F.min("x").alias("least"), F.max("x").alias("most")).toArrow()
    leaf, at, least, most = (c.to_numpy() for c in found.columns)
    by_leaf = {}
    for k in np.unique(leaf):
        here = leaf == k
        ranges = np.zeros(here.sum())
        # Even places are lower ends, odd ones upper ends.
        ranges[at[here]] = np.where(at[here] % 2 == 0, least[here], most[here])
        by_leaf[int(k)] = ranges
    tree.store(by_leaf)
    return tree


_WINDOWS = "array<struct<row int, number int, low double, high double>>"


@dataclass
class _Search:
    """Searches for the best rows in windows of scores.

    ``asked`` has a ``block`` of anchors, its ``labels`` and ``vectors``, and its ``windows``: the anchor's ``row`` in
    the block, the window's ``number`` there, and its least and largest score.
    """

    tree: Tree
    blocks: DataFrame
    size: int
    same: bool
    best: int

    def _pairs(self, asked: DataFrame, first: bool) -> DataFrame:
        """``asked`` blocks and the leaves to look into; in the first round one leaf per window."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(self.tree)
        size = self.size

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    vectors, low, high, _ = _unpacked(one["vectors"], one["windows"], size)
                    tree = shared.value
                    if first:
                        leaves = np.unique(tree.nearest_to(vectors, high))
                    else:
                        leaves = np.unique([leaf for leaf, _ in tree.met(vectors, low, high)])
                    columns = [pa.array(np.full(len(leaves), one["block"]), pa.int64()), pa.array(leaves, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["asked", "leaf"])

        return asked.select("block", "vectors", "windows").mapInArrow(met, "asked long, leaf long")

    def _round(self, asked: DataFrame, first: bool) -> DataFrame:
        """``asked``, ``number``, ``score`` and ``id`` of the best rows per window among the leaves looked into."""
        leaves = self.blocks.select("leaf", F.col("block").alias("held"))
        pairs = written(self._pairs(asked, first).join(leaves, "leaf").select("asked", "held"), "block-pairs")
        anchors = asked.select(
            F.col("block").alias("asked"), *(F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors")), "windows"
        )
        rows = pairs.join(anchors, "asked")
        names = ["ids", "labels", "vectors", "ranges", "leaf"]
        rows = rows.join(self.blocks.select(F.col("block").alias("held"), *names), "held")
        size, same, best = self.size, self.same, self.best
        shared = self.blocks.sparkSession.sparkContext.broadcast(self.tree)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    one = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                    numbers, scores, ids = compared(one, shared.value, size, same, best)
                    asked = np.full(len(numbers), one["asked"])
                    columns = [pa.array(c, pa.int64()) for c in (asked, numbers, scores, ids)]
                    yield pa.RecordBatch.from_arrays(columns, ["asked", "number", "score", "id"])

        found = rows.mapInArrow(compare, "asked long, number long, score long, id long")
        order = Window.partitionBy("asked", "number").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        return written(ranked, "found")

    def result(self, asked: DataFrame) -> DataFrame:
        """``asked``, ``number``, ``rank`` (from 1), ``score`` and ``id`` of the best rows in every window."""
        seen = self._round(asked, True).where(F.col("rank") == self.best)
        bound = seen.groupBy("asked").agg(F.collect_list(F.struct("number", "score")).alias("bounds"))
        # As many numbers as a block of anchors has windows.
        known = F.map_from_entries(F.coalesce("bounds", F.array().cast("array<struct<number:bigint,score:bigint>>")))
        narrowed = asked.join(bound.withColumnRenamed("asked", "block"), "block", "left").withColumn("known", known)
        lower = F.transform(
            "windows",
            lambda w: w.withField(
                "low", F.greatest(w["low"], F.coalesce(F.col("known")[w["number"].cast("bigint")].cast("double"), w["low"]))
            ),
        )
        return self._round(written(narrowed.withColumn("windows", lower).drop("bounds", "known"), "asked"), False)


def _unpacked(vectors: bytes, windows: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One anchor vector per window, the windows' ends, and the anchors' rows."""
    row = np.array([w["row"] for w in windows], np.int64)
    low = np.array([w["low"] for w in windows], float)
    high = np.array([w["high"] for w in windows], float)
    return np.frombuffer(vectors, "<f8").reshape(-1, size)[row] if size else np.zeros((len(row), 0)), low, high, row


def compared(pair: dict, tree: Tree, size: int, same: bool, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window numbers, scores and ids of the ``best`` rows of a block in every window of a block of anchors."""
    ids = np.array(pair["ids"], np.int64)
    rows = np.frombuffer(pair["vectors"], "<f8").reshape(len(ids), size) if size else np.zeros((len(ids), 0))
    vectors, low, high, row = _unpacked(pair["a_vectors"], pair["windows"], size)
    number = np.array([w["number"] for w in pair["windows"]], np.int64)
    own = np.array(pair["a_ids"], np.int64)[row]
    codes = {x: k for k, x in enumerate(dict.fromkeys([*pair["labels"], *pair["a_labels"]]))}
    theirs = np.array([codes[x] for x in pair["labels"]], np.int64)
    mine = np.array([codes[x] for x in pair["a_labels"]], np.int64)[row]

    # The block's own ranges are narrower than its leaf's.
    active = np.ones(len(number), bool)
    ranges, at = np.array(pair["ranges"]), 2
    squares = (vectors * vectors).sum(axis=1)
    if len(ranges) and len(number):
        inner, outer = ring(squares, ranges[:2], low, high)
        for node in tree.path(pair["leaf"]):
            k = len(node.points)
            mine_ranges = ranges[at : at + 2 * k]
            active &= meets(_distances(vectors, node.points), mine_ranges[0::2], mine_ranges[1::2], inner, outer)
            at += 2 * k
    found: tuple[list, list, list] = ([], [], [])
    places = np.flatnonzero(active)
    order = np.argsort(ids, kind="stable")
    ids, rows, theirs = ids[order], rows[order], theirs[order]
    for start in range(0, len(places), 256):
        w = places[start : start + 256]
        scores = vectors[w] @ rows.T
        alike = theirs[None, :] == mine[w][:, None]
        fits = (scores >= low[w][:, None]) & (scores <= high[w][:, None]) & (alike if same else ~alike)
        if same:
            fits &= ids[None, :] != own[w][:, None]
        scores = np.where(fits, scores, -np.inf)
        # The best-th score; of rows that have just that one, those with the smallest ids are taken.
        edge = np.partition(scores, -best, axis=1)[:, -best] if scores.shape[1] > best else np.full(len(w), -np.inf)
        above = fits & (scores > edge[:, None])
        level = fits & (scores == edge[:, None])
        taken = above | (level & (level.cumsum(axis=1) <= best - above.sum(axis=1)[:, None]))
        i, j = np.nonzero(taken)
        found[0].append(number[w][i])
        found[1].append(scores[i, j].clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64))
        found[2].append(ids[j])
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)


def mined(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    shape: Shape | None = None,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """Hard negatives of the anchors: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``vector`` holds whole numbers; a row's score is its inner product with the anchor, exact while it is below 2^53,
    where a missing component counts as 0.  Higher scores come first, ties by smaller key.  An anchor's positives are its
    first ``positives`` other rows of the same label.  For each of them the first ``negatives`` rows of other labels
    are returned whose score is at least ``low`` and at most ``high`` per cent of the positive's.  Rows take no part if
    their key or label is null, or their vector is null or holds a null or a number that is not finite.  Rows that
    repeat a key are rows of their own, but never a positive of that key's anchor; anchors that repeat as a whole
    count once.  Labels may be of any type; an empty table gives no rows.
    """
    shape = shape or Shape()
    rows = df.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _is_usable(F.col("vector")))
    rows = written(rows, "usable")
    kind = dict(rows.dtypes)["label"]
    count, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    tree = _fitted(rows, count, size, shape)
    blocks = _blocks(rows, tree, size, shape.block, True, kind)
    tree = _with_ranges(tree, blocks)

    anchors = rows.where("anchor").dropDuplicates(["id", "label", "vector"])
    asked = _blocks(anchors, tree, size, shape.anchors, False, kind).select("block", "ids", "labels", "vectors")
    every = F.struct(
        F.lit(0).alias("row"), F.lit(0).alias("number"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")
    )
    windows = F.transform("labels", lambda _, i: every.withField("row", i).withField("number", i))
    near = _Search(tree, blocks, size, True, positives).result(asked.withColumn("windows", windows))

    # Per block of anchors as many windows as these have positives.
    number = (F.col("number") * positives + F.col("rank") - 1).alias("number")
    window = F.struct(
        F.col("number").cast("int").alias("row"),
        number.cast("int").alias("number"),
        F.ceil(F.col("score") * low / F.lit(100)).cast("double").alias("low"),
        F.floor(F.col("score") * high / F.lit(100)).cast("double").alias("high"),
    )
    found = near.select("asked", number, "id", "score", window.alias("window"))
    opened = found.groupBy(F.col("asked").alias("block")).agg(F.sort_array(F.collect_list("window")).alias("windows"))
    opened = written(asked.join(opened, "block"), "windows")
    hard = _Search(tree, blocks, size, False, negatives).result(opened)

    names = found.select("asked", "number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = asked.select(F.col("block").alias("asked"), "ids")
    result = hard.join(names, ["asked", "number"]).join(own, "asked")
    anchor = F.get("ids", F.floor(F.col("number") / positives).cast("int")).alias("anchor_id")
    scores = F.col("positive_score"), F.col("score").alias("negative_score")
    return result.select(anchor, "positive_id", "rank", F.col("id").alias("negative_id"), *scores)
