import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import bpe
from cohortlens.llm.queries import op1_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_has_the_library_ids(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text_has_the_library_ids, "t") else None
    library = library or test_any_text_has_the_library_ids.t
    test_any_text_has_the_library_ids.t = library
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(bpe.Encoder(PATH).text(text)) == want


def test_special_tokens_spaces_and_long_words(library):
    random.seed(3)
    texts = [
        "a<|endoftext|>b <|startoftext|><|endoftext|>c",
        "x\x1cy\x1dz w v u\x85t",
        "ΟΔΟΣ İstanbul é ﬁ ＡＢＣ 𝔘 🙂🙂",
        "can't we'll I'D they'Re it'S 12345 a1b2",
        "".join(random.choice("abcdeéß") for _ in range(20_000)),
        "a" * 50_000,
    ]
    encoder = bpe.Encoder(PATH)
    for text in texts:
        assert ids_of(encoder.text(text)) == library.encode(text, add_special_tokens=False).ids


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    encoder = bpe.Encoder(PATH)
    texts = ["one two", "three four five", "one two", "", "six one"] * 3
    for text, packed in zip(texts, encoder.texts(t.encode() for t in texts), strict=True):
        assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 5


def test_words_met_again_are_not_merged_again_by_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    encoder, merged = bpe.Encoder(PATH), []
    packed = encoder.vocabulary.packed
    monkeypatch.setattr(encoder.vocabulary, "packed", lambda words: merged.extend(words) or packed(words))
    texts = [f"common again w{letter}x" for letter in "abcdefgh"]
    for text, ids in zip(texts, encoder.texts(t.encode() for t in texts), strict=True):
        assert ids_of(ids) == library.encode(text, add_special_tokens=False).ids
    assert sorted(merged) == sorted(["common", "again", *(f"w{letter}x" for letter in "abcdefgh")])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("'''strevmldx \t\n!\"-09aé÷ßÿ×", max_size=14), max_size=4))
def test_plain_texts_split_side_by_side_equal_the_pattern(texts):
    words, ends = bpe.plain_words([t.encode("latin-1") for t in texts])
    words, ends = [w.decode("latin-1") for w in words.to_pylist()], [0, *ends]
    assert [words[a:b] for a, b in zip(ends, ends[1:], strict=False)] == [bpe._PLAIN_WORDS.findall(t) for t in texts]


def test_groups_of_plain_and_other_texts_keep_their_order(library):
    texts = ["It's 'sup can't", "", "ÀÉ × ß 'LL 9'9", "日本 it's", None, "a<|endoftext|>b", "don't\nstop''s", " \t", "'re"]
    got = list(bpe.Encoder(PATH).texts(None if t is None else t.encode() for t in texts))
    assert [ids_of(x) for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_trees_side_by_side_equal_single_trees():
    random.seed(8)
    vocabulary = bpe.vocabulary(PATH)
    words = ["".join(random.choices("abcdetionérs,.'9", k=random.randrange(1, 45))).encode() for _ in range(4000)]
    for word, packed in zip(words, vocabulary.merged_all(words), strict=True):
        assert ids_of(packed) == vocabulary.merged(word)


def test_columns_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello  World")], "ids int, text string")
    got = df.withColumn("out", bpe.encoded(F.col("text"), PATH)).orderBy("ids").collect()
    assert [bytes(r.out) for r in got[:2]] == [b"", b""] and len(got[2].out) == 8
    odd = spark.createDataFrame([(struct.pack("<3I", 0, 9_999_999, 1),), (None,)], "ids binary")
    got = [r[0] for r in odd.select(bpe.decoded(F.col("ids"), PATH)).collect()]
    assert got == ["! \"", None]


def test_query_on_every_document(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_bpe(spark, folder).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        row = got[key]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_bpe(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
