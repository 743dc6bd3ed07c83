import math
import random

import numpy as np

from cohortlens.llm import importance
from cohortlens.llm.queries import op6_importance


def frame(spark, texts, ddl="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), ddl)


def test_weights_are_the_log_ratio_of_both_models(spark):
    target, raw = ["good words here", "good words"], ["good words here", "bad", "bad bad", None, ""]
    model = importance.fit(frame(spark, target), frame(spark, raw), n=64)
    hashes = importance._Hashes()

    def share(texts):
        total = np.full(64, 0.5)
        for t in texts:
            for b in importance.buckets((t or "").encode(), hashes, 64):
                total[b] += 1
        return total / total.sum()

    p, q = share(target), share(raw)
    assert np.allclose(model.weights, np.log(p / q))
    got = frame(spark, ["Good WORDS", None, " \n "]).select(importance.weighed("text", model).alias("w")).collect()
    want = sum(math.log(p[b] / q[b]) for b in importance.buckets(b"good words", hashes, 64))
    assert abs(got[0].w - want) < 1e-9 and got[1].w is None and got[2].w is None


def test_kth_largest_equals_sorting(spark):
    random.seed(6)
    values = [random.choice([random.gauss(0, 1e6), random.random(), 5.0, -0.0, 1e300, -1e300]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 350, 699, 700):
        assert importance.kth_largest(df, "x", k) == ordered[k - 1]
    assert importance.kth_largest(df, "x", 0) is None and importance.kth_largest(df, "x", 701) is None
    assert importance.kth_largest(df.limit(0), "x", 1) is None


def test_gumbel_top_k_is_a_weighted_sample(spark):
    """Two kinds of rows, one e² times as likely: the first draw follows the weights."""
    rows = spark.range(4000).selectExpr("id", "id % 2 * 2.0 as w", "id div 2 as pair")
    drawn = rows.withColumn("draw", rows.w + importance.gumbel(rows.id, seed=3)).toPandas()
    won = drawn.loc[drawn.groupby("pair")["draw"].idxmax(), "w"]
    assert abs((won > 0).mean() - math.e**2 / (1 + math.e**2)) < 0.03


def test_target_like_texts_are_kept(spark):
    random.seed(2)
    good = [" ".join(random.choices("the river runs past old stone houses".split(), k=60)) for _ in range(80)]
    bad = [" ".join(random.choices("buy cheap pills now click win".split(), k=60)) for _ in range(40)]
    docs = frame(spark, good + bad)
    model = importance.fit(docs.where("doc_id < 30"), docs)
    kept = {r.doc_id for r in importance.resampled(docs, model, 80 / 120).collect() if r.kept}
    assert kept == set(range(80))


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    ddl = "doc_id long, text string, weight string, draw int, kept int"
    rows = [(None, "same text", "", 1, 1)] * 4 + [(1, None, "", 1, 1), (2, " ", "", 1, 1)]
    df = spark.createDataFrame(rows, ddl)
    model = importance.fit(df.limit(0), df)
    got = importance.resampled(df, model, 0.25).collect()
    assert [r.kept for r in got if r.weight is not None] == [True] * 4
    assert sorted(r.doc_id for r in got if r.weight is None) == [1, 2] and len(got) == 6
    assert importance.resampled(df.limit(0), model, 0.5).collect() == []


def test_query_keeps_good_and_drops_poor_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op6_importance(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and r.toxic == 0]
    poor = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.5, (np.mean(good), np.mean(poor))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    noise = importance.gumbel(documents.doc_id, documents.text, seed=1).alias("noise")
    rows = documents.select("doc_id", "text", noise).collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    target = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    hashes = importance._Hashes()
    found = {r.doc_id: importance.buckets((r.text or "").encode(), hashes) for r in rows}

    def share(ids):
        total = np.full(importance.BUCKETS, 0.5)
        for key in ids:
            np.add.at(total, found[key], 1)
        return total / total.sum()

    weights = np.log(share(target & set(found)) / share(found))
    want = {r.doc_id: (weights[found[r.doc_id]].sum(), r.noise) for r in rows if len(found[r.doc_id])}
    draws = sorted((w + n for w, n in want.values()), reverse=True)
    last = draws[round(0.85 * len(draws)) - 1]
    got = op6_importance(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id not in want:
            assert r.weight is None and not r.kept
        else:
            w, n = want[r.doc_id]
            assert math.isclose(r.weight, w, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.draw, w + n, rel_tol=1e-9, abs_tol=1e-9)
            assert r.kept == (w + n >= last) or math.isclose(w + n, last, rel_tol=1e-9)
