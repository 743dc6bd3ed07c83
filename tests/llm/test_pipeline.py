"""The pipeline's stages, each on its predecessor's output, against brute force."""

import zlib

import pytest
from pyspark.sql import functions as F
from test_near_dup import brute as near_copies
from test_quality_rules import brute as quality_metrics

import corpus_pipeline
from cohortlens.llm import bpe, langid, near_dup, quality_rules
from cohortlens.llm.queries import vocabulary_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """What each stage was given and returned, as lists of rows."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        out = corpus_pipeline.work.written(out, f"test-{name}")
        found[name] = docs.collect(), out.collect()
        docs = out
    return found


def keys(rows):
    return {r.doc_id for r in rows}


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "duplicates", "privacy", "packing"]


def test_language_drops_only_what_cannot_be_told(spark, outputs):
    given, kept = outputs["language"]
    frame = spark.createDataFrame(given)
    learnt = frame.where(~langid.is_held_out(F.col("doc_id")))
    model = langid.fit(learnt)
    for row in given:
        name, _, unsure = model.predict(row.text)
        gone = name == "und" or (unsure and len(row.text) >= corpus_pipeline.SHORT)
        assert (row.doc_id in keys(kept)) != gone
    assert set(kept) <= set(given)


def test_quality_drops_what_a_rule_fails(outputs):
    given, kept = outputs["quality"]
    for row in given:
        m = {**quality_metrics(row.text)}
        fails = False
        for rule in (*quality_rules.BASE_RULES, *quality_rules.RULES):
            of = m[rule.per] if rule.per else 1
            value = rule.scale * m[rule.metric]
            fails |= rule.low is not None and value < rule.low * of
            fails |= rule.high is not None and value > rule.high * of
        assert (row.doc_id in keys(kept)) != fails
    assert set(kept) <= set(given)


def test_duplicates_keeps_one_of_each_group(outputs):
    given, kept = outputs["duplicates"]
    _, lowest = near_copies({r.doc_id: r.text for r in given}, near_dup.Settings())
    assert keys(kept) == set(lowest.values()) and set(kept) <= set(given)


def test_privacy_changes_texts_only_where_it_must(outputs):
    given, done = outputs["privacy"]
    after = {r.doc_id: r for r in done}
    assert keys(given) == set(after) and len(given) == len(done)
    for row in given:
        new = after[row.doc_id]
        assert (new.lang, new.source) == (row.lang, row.source)
        assert new.text == row.text or new.n_chars == len(new.text)
        assert "@" not in row.text or new.text != row.text


def test_packing_holds_every_token_once(outputs):
    given, packed = outputs["packing"]
    encoder = bpe.Encoder(vocabulary_path())
    want = set()
    for row in given:
        ids = encoder.text(row.text) + bytes(4)
        for at in range(0, len(ids), 8192):
            want.add((row.doc_id, at // 8192, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])))
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)


def test_odd_documents_pass_every_stage(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _language int, quality int, `_key` int"
    text = "The house of the river stands near an old bridge and was built by the people of that town in a year. "
    rows = [(None, None, None, None, None, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (2, "12 !", None, "", 4, 1, 1, 1)]
    rows += [(3, text, "en", "s", len(text), 1, 1, 1)] * 2 + [(4, text * 2_000, None, "s", 1, None, None, None)]
    rows += [(None, text + "Write to a.b@c.example.", "en", "s", 1, 1, 1, 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, ddl)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "packing":
                assert out.columns == docs.columns
            docs = corpus_pipeline.work.written(out, "test-odd")
        assert (docs.count() > 0) == bool(given)


def test_python_workers_receive_documents_in_small_batches(spark):
    import pyarrow as pa

    from cohortlens.llm import work

    def rows_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    key = work.BATCH[0]
    texts = spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "repeat('x', 3000) as text")
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.duplicates, corpus_pipeline.packing):
            spark.conf.unset(key)
            stage(spark, texts.limit(3).withColumn("lang", F.lit("en")), "")
            assert max(r.n for r in texts.select("text").mapInArrow(rows_of, "n long").collect()) < 2000
        spark.conf.set(key, "16m")
        corpus_pipeline.packing(spark, texts.limit(3), "")
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)
