import math

import numpy as np

from cohortlens.llm import embeddings
from cohortlens.llm.embeddings import Grid


def brute(rows, cosine):
    """Links, counts and smallest reachable key by comparing all pairs."""
    n = len(rows)
    vectors = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, float) / np.abs(v).max() if ok else None)
    linked = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    linked[i].append(j)
    lowest = {}
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            for j in linked[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        lowest[i] = min(keys, default=None)
    return sorted(
        (str(rows[i][0]), len(linked[i]), str(lowest[i]), rows[i][0] == lowest[i]) for i in range(n)
    )


def corpus(size=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(25):
            base = rng.normal(size=size)
            for noise in rng.choice([0, 0.02, 0.04, 0.08, 0.3], 5):
                v = (base + noise * rng.normal(size=size)) * rng.choice([1, 7])
                rows.append((v.astype(np.float32).tolist(), label))
    rows += [rows[3]] * 30
    order = rng.permutation(len(rows))
    return [(int(k), *rows[i]) for k, i in enumerate(order)]


def run(spark, rows, grid, ddl="vec_id long, embedding array<float>, label int"):
    got = embeddings.near_duplicates(spark.createDataFrame(rows, ddl), grid).collect()
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)


def test_links_equal_brute_force(spark):
    rows = corpus()
    for grid in (Grid(), Grid(block=16, leaf=4, axes=3, meeting=2), Grid(cosine=0.9, block=40, leaf=8)):
        assert run(spark, rows, grid) == brute(rows, grid.cosine)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0)]
    rows += [(7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 0), (10, [2.0, -0.0], 0), (11, [1.0, 0.0], 1)]
    rows += [(12, [1.0], 0), (13, [5.0], 0), (14, [1.0, 0.0, 0.0], 0), (None, [3.0, 0.0], 0), (None, [0.0, 4.0], 0)]
    rows += [(15, [1e38, 1e38], 2), (16, [1e-38, 1e-38], 2), (17, [-1.0, -1.0], 2), (9, [1.0, 0.0], 0)]
    got = run(spark, rows, Grid())
    want = brute(rows, 0.98)
    assert got == want


def test_doubles_empty_tables_and_clashing_columns(spark):
    ddl = "vec_id long, embedding array<double>, label string, node int, n_links string"
    rows = [(1, [1e200, 1e200], "a", 1, ""), (2, [1e-200, 1e-200], "a", 1, ""), (3, [1.0, -1.0], "a", 1, "")]
    got = run(spark, rows, Grid(), ddl)
    assert got == [("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True)]
    assert run(spark, [], Grid(), ddl) == []


def test_skipped_parts_hold_no_links():
    rng = np.random.default_rng(0)
    grid = Grid(leaf=4)
    place = rng.uniform(-1, 1, (300, 4))
    place = place[np.lexsort(np.floor(place / grid.epsilon).T[::-1])]
    near = ((place[:, None] - place[None]) ** 2).sum(axis=2) <= grid.epsilon**2
    looked = np.zeros_like(near)
    for rows, columns in embeddings._near_parts(place, place, True, grid):
        looked[rows, columns] = True
    assert not (near & ~(looked | looked.T)).any()
    assert looked.mean() < 0.5


def test_query_equals_brute_force(spark):
    from cohortlens.llm.queries import op10_embeddings

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in op10_embeddings(spark, folder).collect())
    assert got == brute(rows, 0.98)
