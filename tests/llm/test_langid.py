import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import langid
from cohortlens.llm.queries import op9_language_id

SAMPLES = {
    "de": "Der alte Mann und das kleine Haus stehen nicht weit von der Straße und dem Fluss",
    "en": "The old man and the small house are not far from the road and that river",
    "es": "El viejo hombre y la pequeña casa no están lejos de la calle y del río",
    "fr": "Le vieil homme et la petite maison ne sont pas loin de la rue et de la rivière",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t) for k, t in SAMPLES.items()] + [(None, "ignored"), ("en", None)]
    return langid.fit(spark.createDataFrame(rows, "lang string, text string"))


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 8, 40):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else code.shape[1] // 4), n
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = langid.prepared("Où est la bibliothèque 12 nationale " * 50)
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    assert len(whole) == 3 * len(text) - 3
    monkeypatch.setattr(langid, "_BLOCK", 37)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


def test_languages_nulls_and_long_texts(spark, model):
    assert model.languages == ("de", "en", "es", "fr")
    rows = [("das Haus und der Mann", "de"), ("the house and the man", "en"), ("la casa y el hombre", "es")]
    rows += [("la maison et l'homme", "fr"), (None, "und"), ("", "und"), ("12 34 !?", "und"), ("_ _", "und")]
    rows += [("the old man " * 300_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang_pred string")
    for row in df.withColumn("got", langid.identified(F.col("text"), model)).collect():
        assert row.got.lang_pred == row.lang_pred and 0 <= row.got.score <= 1
        assert (row.got.lang_pred == "und") == (row.got.score == 0)


def test_a_bit_may_be_wrong(model):
    """Flipping any one bit of a clear text leaves its language."""
    bits = model.code[1].astype(float)
    for k in range(len(bits)):
        wrong = bits.copy()
        wrong[k] *= -1
        loss = (model.trust * np.exp(-model.code * wrong)).sum(axis=1)
        assert loss.argmin() == 1


def test_a_mixture_is_ambiguous_before_a_clear_text(model):
    clear = model.predict(SAMPLES["en"])
    mixed = model.predict(SAMPLES["en"] + " " + SAMPLES["de"])
    assert mixed[1] < clear[1] and not clear[2]


def test_one_language_no_language_empty_table(spark):
    ddl = "lang string, text string, score int"
    empty = langid.fit(spark.createDataFrame([], ddl))
    assert empty.predict("the house")[0] == "und"
    one = langid.fit(spark.createDataFrame([("en", "the house", 1)] * 3, ddl))
    assert one.predict("anything") == ("en", 1.0, False)
    none = spark.createDataFrame([], ddl).withColumn("got", langid.identified(F.col("text"), one))
    assert none.collect() == []


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op9_language_id(spark, folder).collect()
    assert len(got) == len(docs)
    right = []
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        if row.held_out and docs[row.doc_id].lang:
            right.append(row.lang_pred == docs[row.doc_id].lang)
    assert sum(right) >= 0.97 * len(right), (sum(right), len(right))


def test_more_labels_than_are_held_at_once(spark, model, monkeypatch):
    rows = spark.createDataFrame([(k, t) for k, t in SAMPLES.items()] * 3, "lang string, text string").coalesce(1)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(langid, "codewords", lambda n: model.code)
    one, same = langid.fit(rows), langid.fit(spark.createDataFrame(rows.collect(), rows.schema))
    assert one.languages == same.languages == model.languages
    assert np.allclose(one.weights, same.weights) and np.allclose(one.trust, same.trust)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 512)
    whole = langid.fit(rows)
    assert np.allclose(one.weights, whole.weights) and np.allclose(one.scale, whole.scale)


def test_a_corpus_with_very_many_labels_has_a_model(spark):
    rows = [(k, t) for k, t in SAMPLES.items()] + [(f"noise{i}", f"zq{i} qz xx" + chr(97 + i % 26) * 5) for i in range(600)]
    found = langid.fit(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert len(found.languages) == 604 and len({tuple(c) for c in found.code}) == 604
    assert [found.predict(t)[0] for t in SAMPLES.values()] == list(SAMPLES)


def test_query_equals_brute_force(spark):
    """Every label, score and flag, from counts of all n-grams one by one."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()

    def counted(text):
        ready = langid.prepared(text)
        found = np.zeros(langid.BUCKETS)
        for n in range(1, langid.LONGEST + 1):
            for at in range(len(ready) - n + 1):
                key = 0
                for k, byte in enumerate(ready[at : at + n], 1):
                    key = (key * 257 + byte + k) % 2**32
                key = key * 2654435761 % 2**32
                found[(key ^ key >> 15) % langid.BUCKETS] += 1
        return found

    grams = {r.doc_id: counted(r.text) for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    names = sorted({r.lang for r in rows if r.lang is not None and r.text is not None and not held[r.doc_id]})
    share = np.full((len(names), langid.BUCKETS), 0.5)
    for r in rows:
        if r.lang is not None and not held[r.doc_id]:
            share[names.index(r.lang)] += grams[r.doc_id]
    share /= share.sum(axis=1, keepdims=True)
    code = langid.codewords(len(names))
    weights = np.array([np.log(share[c > 0].mean(axis=0) / share[c < 0].mean(axis=0)) for c in code.T]).T
    expected = share @ weights * code
    trust = expected.clip(1e-6)
    trust /= trust.sum(axis=1, keepdims=True)
    got = op9_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held[r.doc_id]
        if not grams[r.doc_id].sum():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        margin = grams[r.doc_id] @ weights / grams[r.doc_id].sum()
        bits = (margin / (np.abs(expected).mean(axis=0) + 1e-9)).clip(-3, 3)
        loss = np.sort((trust * np.exp(-code * bits)).sum(axis=1))
        best = names[int((trust * np.exp(-code * bits)).sum(axis=1).argmin())]
        assert r.lang_pred == best and abs(r.score - loss[1] / (loss[0] + loss[1])) < 1e-9
        assert r.ambiguous == (r.score < langid.AMBIGUOUS)
