"""Near duplicates: MinHash signatures, a multi-index Hamming join, and exact confirmation.

A text's set of word shingles has a signature of ``slots`` MinHash values, each cut to 16 bits.  The slots are
split into chunks.  If two signatures differ in at most ``chunks * (errors + 1) - 1`` slots, then by the
pigeonhole principle some chunk differs in at most ``errors`` slots: every chunk is therefore indexed once for each
choice of ``errors`` slots left out, and such a pair shares an index key.  Signature distance then
decides which pairs of a key are compared on their full sets.

Texts with the same set are one class.  The pairs of a key are not formed as rows: its classes are compared with a
leader first, twice with different leaders, and linked classes become one component.  What is left are classes that
share a key and are in different components.  These are put in blocks, those of one large key next to each other;
blocks that share a key are compared as a whole inside a task, by signatures first, then on full sets, and return no
more links than join components.  Links within a component would add nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import unused, written
from cohortlens.operators.ranking import running

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_REMEMBERED = 100_000
_BLOCK = 4096

#: Shingles of all classes of a block together, unless a single one has more.
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Shingle length in words, least similarity in per cent, the shape of the index, and classes of a block at most.

    With 13 chunks of 5 slots and one error, all pairs within 25 of 65 slots are found.  A pair of similarity
    0.8 differs in 13 slots on average; more than 25 happen once in some 10,000 such pairs, and ever
    more rarely above.
    """

    shingle: int = 5
    percent: int = 80
    chunks: int = 13
    width: int = 5
    errors: int = 1
    seed: int = 1
    block: int = 512

    @property
    def slots(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        """Signature distance up to which no pair is missed."""
        return self.chunks * (self.errors + 1) - 1


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, length: int) -> set[tuple[bytes, ...]]:
    """The text's distinct shingles; a text with fewer words is one shingle, one without words has none."""
    found = words(text)
    if len(found) < length:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(length)), strict=False))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


@dataclass
class Signer:
    settings: Settings
    hashes: _Hashes = field(default_factory=_Hashes)

    def __post_init__(self):
        drawn = np.random.default_rng(self.settings.seed)
        n = self.settings.slots
        self.factors = drawn.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = drawn.integers(0, 2**63, n, dtype=np.uint64)

    def hashed(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        get = self.hashes
        found = np.array([get[w] for w in words(text)], np.uint64)
        n = min(self.settings.shingle, len(found))
        if n == 0:
            return found
        total = np.full(len(found) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total ^ found[k : k + len(total)]) * _ODD
            total ^= total >> np.uint64(29)
        total *= _MIX
        return np.unique(total ^ (total >> np.uint64(32)))

    def signature(self, hashed: np.ndarray) -> bytes:
        least = np.full(self.settings.slots, 2**32 - 1, np.uint32)
        for at in range(0, len(hashed), _BLOCK):
            block = hashed[at : at + _BLOCK, None]
            ranks = (((block ^ self.masks) * self.factors) >> np.uint64(32)).astype(np.uint32)
            np.minimum(least, ranks.min(axis=0), out=least)
        return least.astype("<u2").tobytes()


def signatures(df: DataFrame, settings: Settings, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: its ``key`` and ``text_hash``, ``n_shingles``, ``class`` (digest of the set) and ``signature``.

    Class and signature are null where the set is empty.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = Signer(settings)
        for batch in batches:
            n, classes, signed = [], [], []
            for text in batch.column(2):
                hashed = signer.hashed(text.as_py())
                n.append(len(hashed))
                classes.append(xxhash.xxh3_128_digest(hashed.tobytes()) if len(hashed) else None)
                signed.append(signer.signature(hashed) if len(hashed) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64())]
            columns += [pa.array(classes, pa.binary()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), _hash(text).alias("text_hash"), F.col(text))
    names = ["doc_id", "text_hash", "n_shingles", "class", "signature"]
    return rows.mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, class binary, signature binary"
    )


def _hash(text: str) -> Column:
    return F.xxhash64(F.col(text))


def index_keys(classes: DataFrame, settings: Settings) -> DataFrame:
    """One row per index key of every class: ``key``, ``node``, ``n``."""
    kept = [
        [k for k in range(settings.width) if k not in left_out]
        for left_out in itertools.combinations(range(settings.width), settings.errors)
    ]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                part = batch.slice(at, _BLOCK)
                signed = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2")
                signed = signed.reshape(len(part), settings.chunks, settings.width).astype(np.uint64)
                node, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                for chunk, (choice, places) in itertools.product(range(settings.chunks), enumerate(kept)):
                    key = np.full(len(part), chunk * len(kept) + choice + 1, np.uint64) * _ODD
                    for k in places:
                        key = (key ^ signed[:, chunk, k]) * _MIX
                        key ^= key >> np.uint64(31)
                    columns = [pa.array(key.view(np.int64)), pa.array(node), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n"])

    return classes.select("node", "n", "signature").mapInArrow(keys, "key long, node long, n int")


def _distance(a: Column, b: Column) -> Column:
    """Number of slots in which two signatures differ."""

    @F.arrow_udf("int")
    def differing(a: pa.Array, b: pa.Array) -> pa.Array:
        left = np.frombuffer(b"".join(a.to_pylist()), "<u2").reshape(len(a), -1)
        right = np.frombuffer(b"".join(b.to_pylist()), "<u2").reshape(len(b), -1)
        return pa.array((left != right).sum(axis=1), pa.int32())

    return differing(a, b)


def _similar(a: Column, b: Column, settings: Settings) -> Column:
    """Whether the full shingle sets of two texts are similar enough."""
    length, percent = settings.shingle, settings.percent

    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            last, left, verdicts = None, set(), []
            for one, other in zip(a, b, strict=True):
                one = one.as_py()
                if one != last:  # neighbouring rows share their leader
                    last, left = one, shingles(one, length)
                right = shingles(other.as_py(), length)
                common = len(left & right)
                verdicts.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.array(verdicts, pa.bool_())

    return similar(a, b)


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ too much can't be similar enough."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


class _Comparison:
    """Candidate pairs of classes, confirmed on the full sets."""

    def __init__(self, classes: DataFrame, texts: DataFrame, settings: Settings):
        self.classes, self.texts, self.settings = classes, texts, settings

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``u``, ``v``) that are similar; ``pairs`` may repeat."""
        pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = pairs.distinct()
        meta = self.classes.select("node", "signature")
        near = pairs.join(meta.toDF("u", "s"), "u").join(meta.toDF("v", "t"), "v")
        near = near.where(_distance(F.col("s"), F.col("t")) <= self.settings.distance).select("u", "v")
        near = written(near, "near")
        # The member's text first: then a leader's text is dealt once, not once per member.
        members = near.join(self.texts.toDF("v", "text_v"), "v")
        both = members.join(self.texts.toDF("u", "text_u"), "u")
        similar = _similar(F.col("text_u"), F.col("text_v"), self.settings)
        return both.where(similar).select("u", "v")


def near_duplicates(
    df: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Per row of ``df``: ``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest key that links reach, links being pairs of texts whose shingle sets have
    at least ``percent`` of their union in common.  Texts without words are linked with nothing.  A row is
    kept if its key is the component's; rows that repeat a key are judged by their own texts and stay or
    go together if these agree.  A null key counts only where a component has no other.  ``text_hash`` is
    Spark's ``xxhash64`` of the text, by which a verdict finds its row again.
    """
    settings = settings or Settings()
    signed = written(signatures(df, settings, text, key), "signatures")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("low")
    classes = signed.where("class is not null").groupBy("class", "signature", "n_shingles").agg(lowest)
    classes = classes.select(
        F.monotonically_increasing_id().alias("node"),
        "class",
        "signature",
        F.col("n_shingles").cast("int").alias("n"),
        F.col("low.doc_id").alias("doc_id"),
        F.col("low.text_hash").alias("text_hash"),
    )
    classes = written(classes, "classes")

    # Keys that two classes share, and the classes that have one.
    keys = index_keys(classes, settings)
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = written(keys.join(written(shared, "shared-keys"), "key", "left_semi"), "buckets")
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi")
    texts = df.select(F.col(key).cast("bigint").alias("d"), _hash(text).alias("h"), F.col(text).alias("text"))
    wanted = wanted.select("node", "doc_id", "text_hash")
    found = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    texts = written(found.select("node", "text").dropDuplicates(["node"]), "texts")

    compare = _Comparison(classes, texts, settings)
    labels = buckets.select("node").distinct().withColumn("component", F.col("node"))
    members = buckets.withColumn("component", F.col("node"))
    for turn in range(2):
        # First the smallest class leads, so that most of a group have one leader, then one drawn by lot, which
        # joins large components that have but few links.
        rank = F.col("node") if turn == 0 else F.xxhash64(F.col("node"), F.lit(turn))
        order = F.struct(rank.alias("h"), "node", "component", "n")
        leaders = members.groupBy("key").agg(
            F.min(order).alias("l"), F.min("component").alias("x"), F.max("component").alias("y")
        )
        leaders = written(leaders.where("x <> y").select("key", "l"), "leaders")
        pairs = members.join(leaders, "key").where("component <> l.component")
        pairs = pairs.where(_sizes_allow("n", "l.n", settings.percent))
        pairs = pairs.select(F.col("l.node").alias("u"), F.col("node").alias("v"))
        labels = _joined(labels, written(compare.links(pairs), "links"))
        members = buckets.join(labels, "node")
    found = _joined(labels, written(_block_links(members, classes, texts, settings), "links"))
    # Stored, so that the join may split a large component.
    first = written(classes.join(found, "node").groupBy("component").agg(F.min("doc_id").alias("first")), "first")
    named = found.join(first, "component").select("node", "first")
    answers = classes.join(named, "node", "left").select(
        "class", F.coalesce("first", "doc_id").alias("component_id"), F.lit(True).alias("has")
    )
    answers = written(answers, "answers")
    result = signed.join(answers, "class", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _blocks(members: DataFrame, classes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The classes in ``members`` in blocks, and the ``block`` of every ``node``.

    A class stands with the others of its largest key, so that a group of texts with much in common fills few blocks.
    A block is a ``block`` and the ``classes`` of some neighbours in that order, however it is partitioned.
    """
    homes = members.groupBy("node", "component").agg(F.max(F.struct("c", "key")).alias("home"))
    rows = written(classes.select("node", "n").join(homes, "node"), "homes")
    slim = rows.select("node", F.col("home.key").alias("key"), "component", "n")
    share = -(-BLOCK_SHINGLES // settings.block)
    weight = 1 + F.floor(F.col("n") / share)
    placed = running(slim, [], ["key", "node"], weight, "place", row="node")
    placed = placed.select("node", "component", F.floor(F.col("place") / settings.block).alias("block"))
    placed = written(placed, "placed")
    found = classes.select("node", "n", "signature").join(placed, "node")
    found = found.groupBy("block").agg(F.collect_list(F.struct("node", "component", "n", "signature")).alias("classes"))
    return written(found, "class-blocks"), placed.select("node", "block")


def candidates(one: list[dict], two: list[dict], settings: Settings) -> np.ndarray:
    """Which classes of two blocks are of different components, of sizes that allow the similarity, and within
    the signature distance."""

    def lists(block: list[dict]) -> tuple[np.ndarray, ...]:
        signed = np.frombuffer(b"".join(x["signature"] for x in block), "<u2").reshape(len(block), -1)
        return np.array([x["component"] for x in block]), np.array([x["n"] for x in block]), signed

    (c, n, s), (d, m, t) = lists(one), lists(two)
    found = c[:, None] != d[None, :]
    found &= 100 * np.minimum(n[:, None], m[None, :]) >= settings.percent * np.maximum(n[:, None], m[None, :])
    for k in np.flatnonzero(found.any(axis=1)):
        at = np.flatnonzero(found[k])
        found[k, at] = (t[at] != s[k]).sum(axis=1) <= settings.distance
    return found


def joining_links(nodes: list[int], components: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list:
    """Pairs of similar sets, on different sides if there are two, that join ``components``: no more than it takes.

    ``sets`` hold sorted distinct hashes.
    """
    root = {c: c for c in components}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sizes = np.array([len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    both = len(set(sides)) > 1
    right = [k for k, side in enumerate(sides) if side == 1 or not both]
    held = np.concatenate([place[starts[k] : starts[k] + sizes[k]] for k in right])
    edges = np.concatenate([[0], sizes[right].cumsum()[:-1]])
    marks = np.zeros(len(place), bool)
    links = []
    for k, side in enumerate(sides):
        if both and side == 1:
            continue
        mine = place[starts[k] : starts[k] + sizes[k]]
        marks[mine] = True
        common = np.add.reduceat(marks[held], edges, dtype=np.int64)
        marks[mine] = False
        for j in np.flatnonzero(100 * common >= percent * (sizes[k] + sizes[right] - common)):
            a, b = top(components[k]), top(components[right[j]])
            if a != b:
                root[a] = b
                links.append((nodes[k], nodes[right[j]]))
    return links


def _block_links(members: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links (``u``, ``v``) that join the components of classes with a common key, from ``key``, ``node``, ``component``.

    Rows are blocks, pairs of blocks, and the classes of such a pair that have a candidate in it; never pairs of
    classes.
    """
    mixed = members.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")
    )
    mixed = written(mixed.where("x <> y").select("key", "c"), "mixed-keys")
    members = written(members.join(mixed, "key").select("key", "node", "component", "c"), "mixed-members")
    blocks, placed = _blocks(members, classes, settings)
    held = written(members.select("key", "node").join(placed, "node").select("key", "block").distinct(), "key-blocks")
    pairs = held.toDF("key", "a").join(held.toDF("key", "b"), "key").where("a <= b").select("a", "b").distinct()
    rows = written(pairs, "block-pairs").join(blocks.toDF("a", "one"), "a").join(blocks.toDF("b", "two"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a, b, one, two = (batch.column(name)[k].as_py() for name in ("a", "b", "one", "two"))
                found = candidates(one, two, settings)
                columns: list[list] = [[], [], []]
                for side, block in enumerate((one, two) if a < b else (one,)):
                    at = np.flatnonzero(found.any(axis=1 - side))
                    columns[0] += [block[i]["node"] for i in at]
                    columns[1] += [block[i]["component"] for i in at]
                    columns[2] += [side] * len(at)
                n = len(columns[0])
                arrays = [[a] * n, [b] * n, *columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in arrays], ["a", "b", "node", "component", "side"]
                )

    met = written(rows.mapInArrow(near, "a long, b long, node long, component long, side long"), "block-candidates")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(settings)
        for batch in batches:
            sets = [signer.hashed(text.as_py()).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    wanted = texts.join(met.select("node").distinct(), "node", "left_semi").select("node", "text")
    sets = written(wanted.mapInArrow(hashed, "node long, set binary"), "sets")

    def compare(table: pa.Table) -> pa.Table:
        nodes, components, sides = (table[c].to_pylist() for c in ("node", "component", "side"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
        links = joining_links(nodes, components, sets, sides, settings.percent)
        return pa.table({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("uv")})

    return met.join(sets, "node").groupBy("a", "b").applyInArrow(compare, "u long, v long")


def _between(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The links between different components, as edges of components."""
    u = labels.select(F.col("node").alias("u"), F.col("component").alias("c"))
    v = labels.select(F.col("node").alias("v"), F.col("component").alias("d"))
    return links.join(u, "u").join(v, "v").where("c <> d").select(F.col("c").alias("u"), F.col("d").alias("v"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with linked components made one.

    Each round merges every component into the smallest one it has a link with, if that is smaller, and on into
    the one that joins next.  At least half of the components that still have links go in a round.
    """
    labels = written(labels, "labels")
    while not (edges := written(_between(labels, links).distinct(), "between")).isEmpty():
        both = edges.union(edges.select("v", "u"))
        lower = both.groupBy("u").agg(F.min("v").alias("v")).where("v < u")
        lower = written(lower, "lower")
        steps = lower.join(lower.toDF("v", "w"), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        found = labels.join(steps.toDF("component", "lower"), "component", "left")
        labels = written(found.select("node", F.coalesce("lower", "component").alias("component")), "labels")
    return labels


def deduplicated(
    df: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The rows of ``df`` that :func:`near_duplicates` keeps, with the columns of ``df``."""
    verdicts = near_duplicates(df, settings, text, key)
    d, h = unused(df, "_key"), unused(df, "_hash")
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    same = F.col(key).cast("bigint").eqNullSafe(F.col(d)) & (_hash(text) == F.col(h))
    return df.join(gone.distinct(), same, "left_anti")
