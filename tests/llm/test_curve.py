import itertools
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import curve
from cohortlens.llm.queries import op11_curve_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_once_in_steps_of_one(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = curve.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_equal_documents_have_equal_keys_and_similar_ones_near_ones():
    rng = np.random.default_rng(3)
    settings_ = curve.Curve()
    themes = [rng.integers(0, 49_000, 300) for _ in range(5)]
    documents = [rng.choice(themes[k % 5], 400).astype("<u4").tobytes() for k in range(200)]
    keys = curve.keys([*documents, documents[0], b""], settings_, settings_.projection())
    assert keys[200] == keys[0]
    order = np.argsort(keys[:200]) % 5
    assert (order[1:] == order[:-1]).mean() > 0.6  # a fifth by chance


def test_a_document_has_one_key_whatever_lies_beside_it():
    rng = np.random.default_rng(4)
    settings_ = curve.Curve()
    documents = [rng.integers(0, 49_000, n).astype("<u4").tobytes() for n in rng.integers(0, 900, 300)]
    together = curve.keys(documents, settings_, settings_.projection())
    alone = [curve.keys([d], settings_, settings_.projection())[0] for d in documents]
    assert together.tolist() == alone


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**7))
def test_the_rest_is_cut_into_powers_of_two(total):
    ends = curve.tail(total, 2048)
    sizes = np.diff([total // 2048 * 2048, *ends])
    assert sum(sizes) == total % 2048 and all(n & (n - 1) == 0 for n in sizes)


def check(pieces, documents, size=2048):
    """``pieces`` hold every id of ``documents`` (lists of ids) once, without gaps or padding."""
    held = {key: [] for key in documents}
    sequences = {}
    for p in pieces:
        held[p.doc_id].append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for key, ids in documents.items():
        at = 0
        for p in sorted(held[key], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            packed = struct.pack(f"<{p.length}I", *ids[at : at + p.length])
            assert p.ids_crc32 == zlib.crc32(packed)
            at += p.length
        assert at == len(ids)
    short = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size and (at == size or at & (at - 1) == 0)
        short += at < size
    assert short <= size.bit_length()


def shown(pieces):
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()


@pytest.mark.parametrize("size", [2, 8, 64])
def test_any_lengths_are_packed_whole(spark, size):
    rng = np.random.default_rng(size)
    documents = {k: rng.integers(0, 900, n).tolist() for k, n in enumerate([1, 1, 7, 8, 9, 200, 3, 64, 65, 1, 129])}
    rows = [(k, struct.pack(f"<{len(x)}I", *x), len(x), int(rng.integers(0, 3)), "kept") for k, x in documents.items()]
    df = spark.createDataFrame(rows, "doc_id long, ids binary, length long, key long, offset string")
    for n in range(len(rows) + 1):
        if n in (0, 1, 4, 11):
            some = df.where(F.col("doc_id") < n)
            check(shown(curve.packed(some, size)), {k: x for k, x in documents.items() if k < n}, size)


def test_query_equals_the_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.createDataFrame([(-1, "word " * 60_000), (-2, None), (-3, ""), (-4, None)], "doc_id long, text string")
    table.unionByName(long, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    documents = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    got = op11_curve_packing(spark, str(tmp_path)).collect()
    check(got, documents)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_curve_packing(spark, str(tmp_path)).collect() == []
