from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.ranking import running

ROW = st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 9))


@settings(max_examples=8, deadline=None)
@given(st.lists(ROW, max_size=60))
def test_totals_equal_a_walk_in_order(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int, w int")
    got = defaultdict(list)
    for r in running(df, ["k"], ["v"], F.col("w")).collect():
        got[r.k].append((r.before, r.v, r.w))
    assert Counter((k, v, w) for k, found in got.items() for _, v, w in found) == Counter(rows)
    for found in got.values():
        found.sort(key=lambda x: (x[0], x[2] > 0))
        total = 0
        for before, _, w in found:
            assert before == total
            total += w
        values = [(-1 if v is None else v) for _, v, w in found if w]
        assert values == sorted(values)


def test_ranks_of_a_hot_key_and_of_copies(spark):
    # Small data would be merged into one range.
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        ranks_of_copies(spark)
    finally:
        spark.conf.unset(setting)


def ranks_of_copies(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 100))
    df = spark.range(30_000).select(hot.alias("k"), F.lit(1).alias("v")).repartition(7)
    ranks = defaultdict(list)
    placed = running(df, ["k"], ["v"], into="rank").withColumn("task", F.spark_partition_id()).collect()
    for r in placed:
        ranks[r.k].append(r["rank"])
    assert all(sorted(found) == list(range(len(found))) for found in ranks.values())
    assert len(ranks["hot"]) == 10_000
    by_task = Counter(r.task for r in placed if r.k == "hot")
    assert len(by_task) > 1 and max(by_task.values()) < 10_000


def test_totals_without_keys_and_of_no_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("n"))
    got = sorted((r.n, r.before) for r in running(df, [], ["n"], F.col("n"), row="n").collect())
    assert got == [(n, n * (n - 1) // 2) for n in range(1000)]
    assert running(df.limit(0), [], ["n"]).collect() == []
