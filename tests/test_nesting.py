from collections import Counter
from contextlib import contextmanager

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.nesting import attach_parts, collect_parts, split_copies


@contextmanager
def unmerged(spark):
    """Keep small partitions apart: test data would end in one."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.unset(setting)


def gather(df, part_size, **options):
    return collect_parts(
        df, ["k"], {"items": F.col("v")}, part_size=part_size, **options
    ).collect()


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 30)), max_size=120),
    st.integers(1, 9),
)
def test_any_bag_comes_back_whole(spark, bag, part_size):
    df = spark.createDataFrame(bag, "k string, v int")
    parts = gather(df, part_size)
    assert Counter((p.k, v) for p in parts for v in p["items"]) == Counter(bag)
    assert len({(p.k, p.part) for p in parts}) == len(parts)
    assert all(len(p["items"]) <= part_size and list(p["items"]) == sorted(p["items"]) for p in parts)


def test_small_parents_have_one_part(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    parts = gather(df, 10)
    assert sorted((p.k, p.part, len(p["items"])) for p in parts) == [(k, 0, 10) for k in range(10)]


def test_a_hot_parent_is_spread_over_tasks(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000)
    df = spark.range(60_000).select(hot.alias("k"), F.col("id").alias("v"))
    with unmerged(spark):
        collected = collect_parts(df, ["k"], {"items": F.col("v")}, part_size=500)
        placed = collected.withColumn("task", F.spark_partition_id()).collect()
    mine = [p for p in placed if p.k == -1]
    assert sum(len(p["items"]) for p in mine) == 20_000
    assert len(mine) >= 40 and max(len(p["items"]) for p in mine) <= 500
    by_task = Counter()
    for p in mine:
        by_task[p.task] += len(p["items"])
    assert len(by_task) == 4 and max(by_task.values()) < 20_000 / 2


def test_every_large_parent_is_split(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("v"))
    parts = gather(df, 5)
    assert sorted(v for p in parts for v in p["items"]) == list(range(60_000))
    assert max(len(p["items"]) for p in parts) <= 5
    # Each of the 3000 parents has eight salts, so none is in one task as a whole.
    assert len({p.k for p in parts}) == 3000 and len(parts) >= 4 * 3000


def test_copies_are_cut_and_repeated(spark):
    df = spark.createDataFrame(
        [("a", 1, 25), ("a", 2, 1), ("b", 1, 10)], "k string, v int, copies long"
    )
    cut = split_copies(df, 10)
    assert max(r.copies for r in cut.collect()) == 10
    parts = collect_parts(
        cut, ["k"], {"items": F.col("v")}, ["piece"], copies="copies", part_size=10
    ).collect()
    found = Counter((p.k, v) for p in parts for v in p["items"])
    assert found == {("a", 1): 25, ("a", 2): 1, ("b", 1): 10}
    assert max(len(p["items"]) for p in parts) <= 20


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    answers = [
        sorted((p.k, tuple(p["items"])) for p in gather(d, 40))
        for d in (df, df.repartition(7), df.coalesce(1).orderBy(F.desc("v")))
    ]
    assert answers[0] == answers[1] == answers[2]


def test_every_parent_finds_a_part(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    parents = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    parts = collect_parts(df, ["k"], {"items": F.col("v")}, parents=parents)
    found = attach_parts(parents, parts.select("k", "items"), ["k"]).collect()
    assert {r.k: r["items"] for r in found} == {"a": [1], "b": [], None: []}


def whole(parts, key):
    """The parts of a parent, in order, as one list; their numbers have no gaps."""
    mine = sorted((p.part, list(p["items"])) for p in parts if p.k == key)
    assert [n for n, _ in mine] == list(range(len(mine)))
    return [v for _, items in mine for v in items]


def test_the_list_does_not_depend_on_the_part_size(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit("a")).when(F.col("id") % 50 < 10, F.lit("b")).alias("k"),
        (F.col("id") * 7919 % 1000).alias("v"),
    )
    want = sorted(r.v for r in df.where("k = 'a'").collect())
    assert len(want) == 2000
    for part_size in (3, 50, 10_000):
        parts = gather(df, part_size)
        assert whole(parts, "a") == want
        assert sorted(whole(parts, "b")) == whole(parts, "b")
        assert len(whole(parts, None)) == 3000 - 2000 - len(whole(parts, "b"))


def test_elements_with_lists_have_one_order_at_any_part_size(spark):
    df = spark.range(400).select(
        F.lit("a").alias("k"),
        F.struct((F.col("id") * 31 % 20).alias("n"), F.array(F.col("id") % 7).alias("held"), (F.col("id") % 3).alias("x")).alias("v"),
        (F.col("id") % 4).alias("t"),
        F.lit(2).alias("w"),
    )
    found = []
    for part_size in (5, 64, 10_000):
        parts = collect_parts(df, ["k"], {"items": F.col("v")}, ["t"], weight=F.col("w"), part_size=part_size).collect()
        found.append(whole(parts, "a"))
    assert found[0] == found[1] == found[2]
    assert [(v.n, v.x) for v in found[0]] == sorted((v.n, v.x) for v in found[0])


def test_a_hundred_thousand_exact_copies_are_spread(spark):
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.lit(1).alias("v"))
    with unmerged(spark):
        parts = collect_parts(df, ["k"], {"items": F.col("v")}, part_size=1000)
        placed = parts.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((p.part, len(p["items"])) for p in placed) == [(n, 1000) for n in range(100)]
    assert len({p.task for p in placed}) == 4


def test_several_lists_in_parts(spark):
    df = spark.range(500).select(
        F.lit("a").alias("k"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 13 % 500).alias("x"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("s"), F.col("id"))).alias("y"),
        (F.col("id") % 3 + 1).alias("copies"),
    )
    for part_size in (20, 10_000):
        parts = collect_parts(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, copies="copies", part_size=part_size)
        rows = sorted(parts.collect(), key=lambda p: p.part)
        for name in ("x", "y"):
            got = [v for p in rows for v in p[name]]
            want = [v for r in df.collect() if r[name] is not None for v in [r[name]] * r.copies]
            assert got == sorted(want)
