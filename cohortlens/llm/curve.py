"""Packing along a space-filling curve.

Every document becomes a vector of hashed token counts, which a fixed random projection takes to a few dimensions; the
place on a Hilbert curve through these is its key.  Documents are sorted by range of the key, their lengths are
summed up in that order, and the whole line of tokens is cut at every full sequence: neighbours on the curve, alike in
their words, share sequences.  Only the rest at the end of the line is shorter than a sequence; it is cut into powers of
two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import bpe
from cohortlens.llm.work import unused, written
from cohortlens.operators.ranking import running

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 256


@dataclass(frozen=True)
class Curve:
    """Buckets of the hashed vectors, dimensions of the projection, and bits of the key per dimension."""

    buckets: int = 1024
    dimensions: int = 4
    bits: int = 15
    seed: int = 1

    def projection(self) -> np.ndarray:
        """One unit vector per dimension."""
        drawn = np.random.default_rng(self.seed).normal(size=(self.buckets, self.dimensions))
        return drawn / np.sqrt((drawn * drawn).sum(axis=0))


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of whole coordinates below ``2 ** bits``.

    At each level, from the coarsest bit on, a set bit mirrors the finer bits of the first axis and a clear one
    swaps them with it; that turns every cube so that its way in meets its neighbour's way out.  A Gray
    code of the resulting bits is the key.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, finer = 1 << level, (1 << level) - 1
        for axis in range(n):
            is_set = (x[axis] & bit) != 0
            swapped = np.where(is_set, 0, (x[0] ^ x[axis]) & finer)
            x[0] ^= np.where(is_set, finer, swapped)
            x[axis] ^= swapped
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    odd = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        odd ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= odd
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | (x[axis] >> level & 1)
    return key


def keys(ids: list[bytes], curve: Curve, projection: np.ndarray) -> np.ndarray:
    """Curve keys of documents given by their packed ids; one without ids lies in the middle of the space."""
    found = np.zeros((len(ids), curve.dimensions))
    turned = np.ascontiguousarray(projection.T)
    for at in range(0, len(ids), _TOGETHER):
        some = ids[at : at + _TOGETHER]
        tokens = np.frombuffer(b"".join(some), "<u4").astype(np.uint64)
        bucket = ((tokens * _SPREAD) >> np.uint64(33)).astype(np.int64) % curve.buckets
        owner = np.repeat(np.arange(len(some)), [len(x) // 4 for x in some])
        counts = np.bincount(owner * curve.buckets + bucket, minlength=len(some) * curve.buckets)
        vectors = np.log1p(counts.reshape(len(some), curve.buckets))
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        vectors /= np.where(length, length, 1)
        # Not by ``@``: so small a product costs its threads more in waiting than in work.
        np.einsum("ij,kj->ik", vectors, turned, out=found[at : at + len(some)])
    cells = np.floor((found + 1) / 2 * (1 << curve.bits)).clip(0, (1 << curve.bits) - 1)
    return hilbert(cells, curve.bits)


def encoded(df: DataFrame, path: str, curve: Curve | None = None, text: str = "text", end_id: int = 1) -> DataFrame:
    """The columns of ``df`` without ``text``, with ``ids`` (closed by ``end_id``), ``length`` and ``key``.

    ``path`` is the vocabulary file, which every executor must have.  A null text counts as empty.  Columns of
    ``df`` named like a new one are replaced.
    """
    curve = curve or Curve()
    end = end_id.to_bytes(4, "little")
    made = ["ids", "length", "key"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, projection = bpe.Encoder(path), curve.projection()
        for batch in batches:
            texts = batch.column(len(batch.schema) - 1).cast(pa.binary())
            ids = list(encoder.texts(t.as_py() for t in texts))
            key = keys(ids, curve, projection)
            columns = [pa.array([x + end for x in ids], pa.binary()), pa.array([len(x) // 4 + 1 for x in ids], pa.int64())]
            columns = [*batch.columns[:-1], *columns, pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *made])

    rest = [c for c in df.columns if c not in (text, *made)]
    shown = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias(unused(df, "_text")))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]]
    return shown.mapInArrow(encode, ", ".join([*kinds, "ids binary", "length long", "key long"]))


def tail(total: int, size: int) -> list[int]:
    """Where the sequences end that hold what is left after the full ones: powers of two, large ones first."""
    end, found = total // size * size, []
    for bit in reversed(range(size.bit_length())):
        if (total % size) >> bit & 1:
            end += 1 << bit
            found.append(end)
    return found


def packed(df: DataFrame, size: int = 2048) -> DataFrame:
    """One row per piece of the rows that :func:`encoded` returns: ``start``, ``length``, ``ids``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and the other columns carried.

    Every id lies in one piece, the pieces of a sequence follow each other from offset 0 in the order of the curve,
    and each sequence is ``size`` ids long or, at the end of all, a power of two.  Rows with equal keys come in any
    order.  Columns of ``df`` named like a new one are replaced; an empty table gives none.
    """
    new = ["ids", "length", "key", "start", "doc_tokens", "sequence_id", "offset"]
    rest = [c for c in df.columns if c not in new]
    row, before = unused(df, "_document"), unused(df, "_first")
    rows = written(df.select(*(F.col(f"`{c}`") for c in [*rest, *new[:3]])).withColumn(row, F.monotonically_increasing_id()), "encoded")
    slim = rows.select(F.col(row).alias("document"), "key", F.col("length").alias("n"))
    total = slim.agg(F.sum("n")).first()[0] or 0
    # Sorting needs no ids: they meet their place afterwards.
    places = running(slim, [], ["key", "document"], F.col("n"), "first", row="document")
    places = places.select(F.col("document").alias(row), F.col("first").alias(before))
    joined = rows.join(places, row)

    full = total // size * size
    ends = F.array(*(F.lit(e).cast("bigint") for e in tail(total, size)))
    s, e = F.col(before), F.col(before) + F.col("length")
    step, none = F.lit(size).cast("bigint"), F.array().cast("array<bigint>")
    first, last = F.floor(s / size) * size + size, F.least(e - 1, F.lit(full))
    cuts = F.when(first <= last, F.sequence(first, last, step)).otherwise(none)
    cuts = F.concat(F.array(s), cuts, F.filter(ends, lambda x: (x > s) & (x < e)))
    joined = joined.withColumn("_cuts", cuts)

    def piece(at, i):
        until = F.coalesce(F.get("_cuts", i + 1), e)
        # A whole number of sequences lies before the rest, then come the ends that are passed.
        passed = F.filter(ends, lambda x: x <= at)
        in_rest = at >= full
        opened = F.when(in_rest, F.coalesce(F.get(passed, F.size(passed) - 1), F.lit(full))).otherwise(F.floor(at / size) * size)
        number = F.when(in_rest, F.lit(full // size) + F.size(passed)).otherwise(F.floor(at / size))
        return F.struct(
            (at - s).alias("start"),
            (until - at).alias("length"),
            F.substring("ids", ((at - s) * 4 + 1).cast("int"), ((until - at) * 4).cast("int")).alias("ids"),
            F.col("length").alias("doc_tokens"),
            number.cast("bigint").alias("sequence_id"),
            (at - opened).cast("bigint").alias("offset"),
        )

    cut = joined.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.transform("_cuts", piece)).alias("_piece"))
    return cut.select(*(F.col(f"`{c}`") for c in rest), "_piece.*")
