"""Importance resampling: texts that look like a target are sampled from raw text.

Words, runs of other signs, and pairs of neighbours are hashed into buckets.  A generative model is the share of each bucket, once
in target texts and once in all raw text; a text's weight is the log ratio of its probability under the two.
Weights plus Gumbel noise, the largest ``k`` taken, are a sample without replacement in proportion to the
weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import unused, written

BUCKETS = 10_000
_REMEMBERED = 400_000
_BINS = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Words and runs of other signs, in lower case: signs tell prose from markup and noise.
_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def buckets(text: bytes | None, hashes: _Hashes, n: int = BUCKETS) -> np.ndarray:
    """Buckets of all words, runs of signs, and pairs of neighbours among them, of a whole text."""
    found = np.array([hashes[w] for w in _WORDS.findall((text or b"").lower())], np.uint64)
    pairs = (found[:-1] * _ODD ^ found[1:]) * _ODD
    every = np.concatenate([found, pairs ^ (pairs >> np.uint64(31))])
    return (every % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw share, per bucket."""

    weights: np.ndarray

    def weight(self, text: bytes | None, hashes: _Hashes) -> float | None:
        found = buckets(text, hashes, len(self.weights))
        return float(self.weights[found].sum()) if len(found) else None


def _counted(texts: DataFrame, n: int) -> np.ndarray:
    """How often each bucket occurs; the driver receives ``n`` numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros(n, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(buckets(text.as_py(), hashes, n), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    counts = np.zeros(n)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def fit(target: DataFrame, raw: DataFrame, text: str = "text", n: int = BUCKETS) -> Model:
    """Models of the texts of ``target`` and of all of ``raw``; without target texts all weights are zero."""
    wanted, everything = (_counted(df.select(text), n) for df in (target, raw))
    if not wanted.sum():
        return Model(np.zeros(n))
    # A bucket that the target lacks counts as half an occurrence.
    share = [(c + 0.5) / (c + 0.5).sum() for c in (wanted, everything)]
    return Model(np.log(share[0] / share[1]))


def weighed(text: Column, model: Model) -> Column:
    """Log importance weight of a whole text; null for a text without words."""

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for batch in batches:
            texts = batch.cast(pa.binary())
            yield pa.array([model.weight(t.as_py(), hashes) for t in texts], pa.float64())

    return weigh(text)


def gumbel(*key: Column, seed: int) -> Column:
    """Gumbel noise that depends on the key and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value of a column of doubles, null values left out; None if there are fewer.

    The range that holds it is narrowed by counting values in equal parts of it, until one value is left: every
    step sends a thousand counts to the driver.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / _BINS
        part = F.least(F.floor((F.col("x") - low) / width).cast("int"), F.lit(_BINS - 1)) if width else F.lit(0)
        inside = values.where(F.col("x").between(low, high))
        found = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        for row in sorted(found.toArrow().to_pylist(), key=lambda r: -r["part"]):
            if k <= row["n"]:
                low, high = row["a"], row["b"]
                break
            k -= row["n"]
    return low


def resampled(
    df: DataFrame, model: Model, fraction: float, key: str = "doc_id", text: str = "text", seed: int = 1
) -> DataFrame:
    """Per row: ``key``, ``weight``, ``draw`` (weight plus noise) and ``kept``.

    Kept are the ``fraction`` of all rows with words that have the largest draws; rows tied with the last one
    stay too, so that rows alike are treated alike.  A text without words has no weight and is never kept.
    """
    noise = gumbel(F.col(key), F.col(text), seed=seed)
    rows = df.select(F.col(key), weighed(F.col(text), model).alias(unused(df, "weight")), noise.alias("_noise"))
    rows = rows.toDF(key, "weight", "_noise")
    rows = written(rows.select(key, "weight", (F.col("weight") + F.col("_noise")).alias("draw")), "draws")
    n = rows.where("draw is not null").count()
    last = kth_largest(rows, "draw", round(fraction * n))
    kept = F.coalesce(F.col("draw") >= F.lit(last), F.lit(False)) if last is not None else F.lit(False)
    return rows.withColumn("kept", kept)
