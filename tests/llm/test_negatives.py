import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import negatives
from cohortlens.llm.queries import ORACLE_SQL, op12_hard_negatives

SMALL = negatives.Shape(degree=3, leaf=8, sample=60, block=16, anchors=3)
SCHEMA = "vec_id long, label string, embedding array<double>"


def expected(rows, every=5, positives=5, best=10, low=30, high=90):
    """By brute force; the rows are usable ones."""
    out = []
    for a, label, e in rows:
        if a % every:
            continue

        def ranked(found):
            return sorted(found, key=lambda x: (-x[1], x[0]))

        def score(x, e=e):
            n = max(len(x), len(e))
            return int(np.dot([*x, *[0] * (n - len(x))], [*e, *[0] * (n - len(e))]))

        mine = ranked((k, score(x)) for k, other, x in rows if other == label and k != a)[:positives]
        others = ranked((k, score(x)) for k, other, x in rows if other != label)
        for positive, p in mine:
            inside = [(k, s) for k, s in others if low * p <= 100 * s <= high * p][:best]
            out += [(a, positive, n, k, p, s) for n, (k, s) in enumerate(inside, 1)]
    return sorted(out)


def outcome(df, every=5, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = negatives.mined(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in got.select(names).collect())


def drawn(n, seed, size=6, spread=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, size))
    return [
        (k, "xyz"[rng.integers(3)], np.floor(centres[rng.integers(5)] + rng.normal(0, 6, size)).tolist()) for k in range(n)
    ]


@pytest.mark.parametrize("shape", [SMALL, negatives.Shape(degree=2, leaf=2, sample=300, block=5, anchors=50), None])
def test_any_shape_equals_brute_force(spark, shape):
    rows = drawn(260, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert outcome(df, shape=shape) == expected(rows)


def test_ties_and_very_many_copies(spark):
    rows = [(k, "ab"[k % 2], [float(k % 3), 1.0, 2.0]) for k in range(200)]
    rows += [(k, "c", [5.0, 5.0, 5.0]) for k in range(200, 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert outcome(df, 50, shape=SMALL) == expected(rows, 50)


def test_the_tree_leaves_out_far_leaves(spark):
    rows = drawn(400, 2, spread=300)
    vectors = np.array([r[2] for r in rows])
    tree = negatives.Tree(vectors, 400, SMALL)
    leaves = tree.leaf_of(vectors)
    tree.store({int(k): np.array(tree.ranges(int(k), vectors[leaves == k])) for k in np.unique(leaves)})
    scores = vectors[:1] @ vectors.T
    low = np.sort(scores[0])[-5:-4]
    met = {leaf for leaf, _ in tree.met(vectors[:1], low, np.array([np.inf]))}
    assert set(leaves[scores[0] >= low]) <= met
    assert len(met) < tree.leaves / 2


def test_unusable_rows_short_vectors_and_odd_columns(spark):
    rows = [r for r in drawn(60, 3) if r[0] != 7]
    rows[5] = (5, "x", [3.0])
    rows[6] = (6, "x", [])
    bad = [(100, None, [1.0] * 6), (105, "x", None), (110, "x", [None] * 6), (115, "x", [float("nan")] * 6),
           (120, "x", [float("inf")] * 6), (None, "x", [1.0] * 6)]
    df = spark.createDataFrame([*rows, *bad], SCHEMA).withColumns({"anchor": F.lit("?"), "leaf": F.lit(1), "id": F.lit(0)})
    assert outcome(df, shape=SMALL) == expected(rows)
    assert outcome(df.where("vec_id > 99"), shape=SMALL) == []
    assert outcome(df.limit(0)) == []
    nothing = spark.createDataFrame([(0, "x", []), (5, "x", []), (6, "y", [])], SCHEMA)
    assert outcome(nothing) == expected([(0, "x", []), (5, "x", []), (6, "y", [])])


def test_rows_that_repeat_a_key(spark):
    rows = drawn(40, 6) + [(10, "x", [9.0] * 6), (11, "y", [8.0] * 6)]
    rows += [rows[12], rows[12]]
    got = outcome(spark.createDataFrame(rows, SCHEMA), shape=SMALL)
    assert got == expected(rows)


def test_very_many_components(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "ab"[k % 2], np.floor(rng.normal(3, 2, 20_000)).tolist()) for k in range(12)]
    assert outcome(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
        want = con.execute(ORACLE_SQL["op12_hard_negatives"])
        names = [d[0] for d in want.description]
        want = sorted(want.fetchall())
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, path).select(names).collect())
    assert got == want and want
