"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier tells the languages that have
it from those that don't, by the log ratio of their byte n-gram frequencies.  A text belongs to the language
whose codeword is nearest to the predicted bits under an exponential loss; a bit weighs more for a language
the more sharply its classifier separates that language.  Texts that are about as near to a second codeword
are flagged as ambiguous.

Fitting counts the n-grams of all labelled texts, in hashed buckets, so that the model's size depends only on
the number of languages and buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import written

UNDETERMINED = "und"

#: Buckets of hashed n-grams, longest n-gram in bytes, and most languages whose counts are held at once.
BUCKETS = 1 << 14
LONGEST = 3
MOST_LANGUAGES = 512

#: A text is ambiguous if the second codeword's share of both losses is beyond one minus this.
AMBIGUOUS = 0.52

_BLOCK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes that are no letters part words.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def prepared(text: str | None) -> bytes:
    """The words of a text in lower case, one space around each; empty if it has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return b" %s " % b" ".join(text.lower().encode().translate(_WORDS).split())


def grams(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of one to :data:`LONGEST` bytes, in blocks of bounded size."""
    for at in range(0, len(text), _BLOCK):
        codes = np.frombuffer(text[at : at + _BLOCK + LONGEST - 1], np.uint8).astype(np.uint32)
        key = np.zeros(len(codes), np.uint32)
        for n in range(1, LONGEST + 1):
            starts = min(len(codes) - n + 1, _BLOCK)
            if starts <= 0:
                break
            key = key[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :] + np.uint32(n)
            mixed = key[:starts] * np.uint32(2654435761)
            yield ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """A codeword of ±1 bits per language: every division of a few languages, random ones of many."""
    if n <= 7:
        divisions = range(1, 1 << max(0, n - 1))
        bits = [[1 if i == 0 or not d >> (i - 1) & 1 else -1 for d in divisions] for i in range(n)]
        return np.array(bits, np.int8).reshape(n, len(divisions) if n else 0)
    best, best_apart = None, -1
    width = 10 * int(np.ceil(np.log2(n)))
    if n > MOST_LANGUAGES:  # random words of so many bits are far apart; comparing all pairs would cost too much
        code = np.random.default_rng(0).choice(np.array([-1, 1], np.int8), (n, width))
        return code[:, np.abs(code.sum(axis=0)) < n]
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T + 2 * width * np.eye(n)).min()
        if apart > best_apart:
            best, best_apart = code, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # bucket, bit
    trust: np.ndarray  # language, bit: how much a bit says about a language
    scale: np.ndarray  # bit: the usual size of its margin

    def margins(self, text: bytes) -> np.ndarray:
        """Mean weight of the text's n-grams for every bit."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for found in grams(text, len(self.weights)):
            total += np.bincount(found, minlength=len(self.weights)) @ self.weights
            n += len(found)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is ambiguous.

        A text without letters is ambiguous; where no language was learnt, others aren't.
        """
        ready = prepared(text)
        if not ready or not self.languages:
            return UNDETERMINED, 0.0, not ready
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        bits = np.clip(self.margins(ready) / self.scale, -3, 3)
        loss = (self.trust * np.exp(-self.code * bits)).sum(axis=1)
        first, second = np.argsort(loss, kind="stable")[:2]
        score = float(loss[second] / (loss[first] + loss[second]))
        return self.languages[first], score, score < AMBIGUOUS


def _counted(buckets: int, most: int):
    def emitted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])
        totals.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in totals:
                    if len(totals) >= most:  # a full table is sent on, and Spark sums
                        yield from emitted(totals)
                    totals[lang] = np.zeros(buckets, np.int64)
                for found in grams(prepared(text.as_py()), buckets):
                    totals[lang] += np.bincount(found, minlength=buckets)
        yield from emitted(totals)

    return count


def _shares(counts: DataFrame, languages: tuple[str, ...], buckets: int) -> np.ndarray:
    """Smoothed share of every bucket in the n-grams of a few languages: language, bucket."""
    found = counts.where(F.col("lang").isin(*languages)).toArrow()
    n = np.full((len(languages), buckets), 0.5)
    row = {name: i for i, name in enumerate(languages)}
    at = np.array([row[x] for x in found["lang"].to_pylist()], np.int64)
    n[at, found["bucket"].to_numpy()] += found["n"].to_numpy()
    return n / n.sum(axis=1, keepdims=True)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from every row with a text and a language.

    The driver receives the names of all languages, which the model holds, and one count per language and bucket for
    ``MOST_LANGUAGES`` languages at a time, however large ``df`` is and however many they are.  Texts without letters
    teach nothing; without any others the model has no language and predicts ``und``.
    """
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    most = MOST_LANGUAGES
    counts = rows.mapInArrow(_counted(buckets, most), "lang string, bucket long, n long")
    counts = written(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    # One name per language, as in the model itself; the names come partition by partition.
    languages = tuple(sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator()))
    blocks = [slice(at, at + most) for at in range(0, len(languages), most)]
    held = cache(lambda at: _shares(counts, languages[at : at + most], buckets))
    shares = held if len(blocks) == 1 else held.__wrapped__  # one block is read once, many are read in turn
    code = codewords(len(languages))
    if not code.size:
        empty = np.zeros((len(languages), 0))
        return Model(languages, code, np.zeros((buckets, 0)), empty, np.zeros(0))
    n_has, n_lacks = (code > 0).sum(axis=0), (code < 0).sum(axis=0)
    with_bit, without = np.zeros((2, buckets, code.shape[1]))
    for b in blocks:
        share = shares(b.start)
        with_bit += share.T @ ((code[b] > 0) / n_has)
        without += share.T @ ((code[b] < 0) / n_lacks)
    weights = np.log(with_bit / without)
    # Mean margin of each language on its own side.
    expected = np.concatenate([shares(b.start) @ weights for b in blocks]) * code
    trust = np.clip(expected, 1e-6, None)
    trust /= trust.sum(axis=1, keepdims=True)
    return Model(languages, code, weights, trust, np.abs(expected).mean(axis=0) + 1e-9)


def identified(text: Column, model: Model) -> Column:
    """Struct ``lang_pred``, ``score``, ``ambiguous`` of a whole text.

    A null text, or one without a letter, is ``und`` with score 0; equal texts have equal answers.  Only
    the text is looked at.
    """

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch]
            names, scores, unsure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                ["lang_pred", "score", "ambiguous"],
            )

    return predict(text)


def is_held_out(key: Column) -> Column:
    """The third of all rows by key that models are measured on; a null key is not in it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
