import random

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import near_dup
from cohortlens.llm.components import components
from cohortlens.llm.near_dup import Settings, Signer


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(texts, settings):
    sets = {k: near_dup.shingles(t, settings.shingle) for k, t in texts.items()}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= settings.percent * len(sets[a] | sets[b])
    ]
    return {k: len(s) for k, s in sets.items()}, smallest_reachable(sets, links)


def corpus():
    """Families of copies at falling similarity, one large family, and texts of their own."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=4))
    texts = [None, "", " \n\t", "One", "one", "one two", "ONE  two", "a b a b a b a b"]
    for family in range(25):
        base = [word() for _ in range(random.choice([12, 60, 200]))]
        for changes in (0, 0, 1, 2, 4, 8, 16):
            copy = list(base)
            for _ in range(changes):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if family % 3 == 0 else "\n".join(copy))
    base = [word() for _ in range(150)]
    for _ in range(120):
        copy = list(base)
        for _ in range(random.choice([1, 5, 9, 13])):
            copy[random.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    random.shuffle(texts)
    return dict(enumerate(texts))


def test_components_equal_brute_force(spark):
    texts = corpus()
    for settings in (Settings(shingle=2), Settings(), Settings(block=3)):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        sizes, lowest = brute(texts, settings)
        got = near_dup.near_duplicates(df, settings).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], lowest[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_a_large_group_on_both_sides_of_the_threshold(spark):
    """2,000 texts that share most of their words, at similarities of about 0.75 to 0.85."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(2000):
        copy = list(base)
        for at in rng.sample(range(400), rng.randrange(9, 30)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(copy)
    sets = {k: near_dup.shingles(t, 2) for k, t in texts.items()}
    places = {x: i for i, x in enumerate(set().union(*sets.values()))}
    often = np.zeros((2000, len(places)), np.float32)
    for k, found in sets.items():
        often[k, [places[x] for x in found]] = 1
    common = often @ often.T
    sizes = often.sum(axis=1)
    share = 100 * common / (sizes[:, None] + sizes[None, :] - common)
    assert (share > 75).any() and np.median(share) < 80
    lowest = smallest_reachable(texts, zip(*np.nonzero(np.triu(share >= 80, 1)), strict=True))
    assert 100 < len(set(lowest.values())) < 1990
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(df, Settings(shingle=2, block=100)).collect()
    assert {r.doc_id: r.component_id for r in got} == lowest


def test_null_keys_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    ddl = "doc_id long, text string, node int, `class` string, text_hash int, kept boolean"
    rows = [(7, text), (7, text), (None, text), (5, text + " x"), (9, "other words here"), (None, "alone in the world")]
    df = spark.createDataFrame([(*r, 1, "c", 2, False) for r in rows], ddl)
    found = near_dup.near_duplicates(df)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found.collect()) == [
        (0, 0, True), (0, 5, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True),
    ]
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == sorted([text + " x", "other words here", "alone in the world"])
    empty = spark.createDataFrame([], ddl)
    assert near_dup.near_duplicates(empty).collect() == [] and near_dup.deduplicated(empty).count() == 0


def test_all_pairs_within_the_distance_share_a_key(spark):
    settings = Settings()
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        a = rng.integers(0, 2**16, settings.slots, dtype=np.uint16)
        b = a.copy()
        far = rng.permutation(settings.slots)[: settings.distance]
        b[far] ^= 1
        rows += [(2 * k, 9, a.astype("<u2").tobytes()), (2 * k + 1, 9, b.astype("<u2").tobytes())]
    df = spark.createDataFrame(rows, "node long, n int, signature binary")
    keys = near_dup.index_keys(df, settings)
    assert keys.count() == 80 * settings.chunks * settings.width
    pairs = keys.alias("a").join(keys.alias("b"), "key").where("a.node + 1 = b.node and a.node % 2 = 0")
    assert pairs.select("a.node").distinct().count() == 40


def test_signature_of_a_long_text_is_taken_over_all_blocks(monkeypatch):
    signer = Signer(Settings())
    hashed = signer.hashed(" ".join(map(str, range(20_000))))
    whole = signer.signature(hashed)
    monkeypatch.setattr(near_dup, "_BLOCK", 501)
    assert signer.signature(hashed) == whole and len(hashed) == 20_000 - 4


def test_components_of_chains_stars_and_loops(spark):
    random.seed(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(999, i) for i in range(200, 400)]
    mixed = [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(120)]
    edges = chain + star + mixed + [(5, 5), (6, 7), (7, 6), (6, 7)]
    random.shuffle(edges)
    nodes = {x for e in edges for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {k: v for k, v in smallest_reachable(nodes, edges).items() if k != v}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_kept_documents_are_whole(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = near_dup.deduplicated(df)
    assert kept.schema == df.schema
    assert kept.exceptAll(df).count() == 0 and 0 < kept.count() < df.count()
    assert kept.where(F.col("doc_id").isNull()).count() == 0
