import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bpe, packing
from cohortlens.llm.packing import Capacity
from cohortlens.llm.queries import op2_packing, vocabulary_path


def checked(rows, capacity=None):
    """No sequence breaks a limit, and its pieces stand side by side from 0."""
    capacity = capacity or Capacity()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        if len(found) > 1:
            assert at <= capacity.tokens and len(found) <= capacity.pieces
            assert sum(n * n for _, n in found) <= capacity.attention
    return bins


def lengths(spark, sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, length long")


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_limit_holds(spark, score):
    random.seed(2)
    sizes = [random.choice([1, 5, 300, 700, 2048, random.randrange(1, 2048)]) for _ in range(900)]
    for capacity in (Capacity(), Capacity(pieces=3), Capacity(attention=1_000_000)):
        rows = packing.packed(lengths(spark, sizes), capacity, score=score, group=200).collect()
        assert sorted(r.k for r in rows) == list(range(900))
        checked(rows, capacity)


def test_few_sequences(spark):
    random.seed(4)
    sizes = [random.randrange(1, 1200) for _ in range(4000)]
    bins = checked(packing.packed(lengths(spark, sizes)).collect())
    assert len(bins) <= 1.01 * sum(sizes) / 2048 + 1


def test_nulls_ties_empty_and_clashing_columns(spark):
    ddl = "doc_id long, length long, offset string, _row int, _group int"
    rows = [(None, 10, "x", 1, 2)] * 50 + [(7, None, None, None, None), (8, -3, "", 0, 0)]
    got = packing.packed(spark.createDataFrame(rows, ddl), group=10)
    assert got.columns == ["doc_id", "length", "_row", "_group", "sequence_id", "offset"]
    assert got.count() == 52 and got.where("doc_id is null").count() == 50
    assert packing.packed(spark.createDataFrame([], ddl)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame(rows, ddl), score="other")


def test_pieces_of_long_null_and_empty_ids(spark):
    ids = [struct.pack(f"<{n}I", *range(1, n + 1)) for n in (0, 3, 4, 5, 9)]
    df = spark.createDataFrame([*enumerate(ids), (9, None)], "piece int, ids binary")
    got = packing.pieces(df.withColumnRenamed("piece", "k"), size=5).orderBy("k", "piece").collect()
    assert [(r.k, r.piece, r.start, r.length) for r in got] == [
        (0, 0, 0, 1), (1, 0, 0, 4), (2, 0, 0, 5), (3, 0, 0, 5), (3, 1, 5, 1), (4, 0, 0, 5), (4, 1, 5, 5), (9, 0, 0, 1),
    ]
    assert bytes(got[3].ids) == ids[3] and bytes(got[4].ids) == bytes(4)


def test_query_on_every_document(spark):
    folder = "/root/testdata/sf0.001"
    encoder = bpe.Encoder(vocabulary_path())
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = encoder.text(r.text) + bytes(4)
        for i in range(0, len(ids), 8192):
            part = ids[i : i + 8192]
            want.add((r.doc_id, i // 8192, i // 4, len(part) // 4, zlib.crc32(part)))
    rows = op2_packing(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    bins = checked(rows)
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_dealing_ignores_values(spark):
    df = spark.createDataFrame([(None, 5)] * 4000, "doc_id long, length long").repartition(4)
    per_group = packing.packed(df, group=100).groupBy((F.col("sequence_id") / 2**32).cast("int")).count()
    assert max(r["count"] for r in per_group.collect()) < 300
