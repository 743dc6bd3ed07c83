"""What the plans must and must not contain when no table is small enough to broadcast."""

import re

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortlens.operators import learners, programmes
from cohortlens.operators.joins import _is_small
from cohortlens.operators.nesting import expand
from cohortlens.plans import learner_report, programme_report
from cohortlens.schemas import INPUTS
from cohortlens.sinks import write_tables
from cohortlens.sources import derived_tables, frame_tables, parquet_tables

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star"))
    write_tables(derived_tables(spark, "/root/testdata/sf0.001"), root)
    return parquet_tables(spark, root)


@pytest.fixture
def conf(spark):
    before = {}

    def put(**settings):
        for key, value in settings.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BLOCKS = {
    "ongoing": lambda t: programmes.ongoing_course_progress(t, AS_OF),
    "inactive": programmes.inactive_users,
    "lagging": lambda t: programmes.lagging_users(t, AS_OF),
    "certificates": programmes.user_cert_status,
    "rollup": programmes.programme_rollup,
    "learner modules": learners.learner_modules,
    "learner courses": learners.learner_courses,
    "learner data": learners.learner_data,
    "programs": lambda t: programme_report.programs(t, AS_OF),
    "programme documents": lambda t: programme_report.programme_documents(t, AS_OF),
    "learner documents": learner_report.learner_progress_documents,
    "programme presentation": lambda t: programme_report.program_presentation(t, AS_OF),
    "learner presentation": learner_report.learner_presentation,
}


@pytest.mark.parametrize("name", BLOCKS)
def test_plans_stay_in_the_jvm_without_products(conf, star, name):
    conf(**NO_BROADCAST)
    text = plan(BLOCKS[name](star))
    assert not re.search("Python|CartesianProduct|NestedLoop|Expand|SinglePartition", text)


def test_scans_read_only_what_they_need(star):
    text = plan(programmes.program_metrics(star))
    assert "ReadSchema: struct<programme_id:string,progress_percentage:double," in text
    text = plan(programmes.inactive_users(star))
    assert "Not(EqualTo(is_alive,true))" in text
    text = plan(programmes.ongoing_course_progress(star, AS_OF))
    assert "GreaterThan(course_offering_end_timestamp,1999-01-01 00:00:00.0)" in text
    assert "LessThanOrEqual(course_offering_start_timestamp,1999-01-01 00:00:00.0)" in text
    assert "EqualTo(is_valid_offering,1)" in plan(programme_report.valid_offerings(star))


def test_each_fact_is_shuffled_once_per_key(conf, star):
    conf(**NO_BROADCAST)
    text = plan(learners.learner_modules(star))
    assert text.count("SortMergeJoin") == 2 and text.count("Exchange ") == 4


def test_small_dimensions_spare_the_shuffle(conf, star):
    # With known small dimensions the fact meets each by broadcast; the rows are the same.
    small = learners.learner_modules(star)
    assert "Exchange hashpartitioning" not in plan(small)
    assert plan(small).count("BroadcastHashJoin") == 2 and "BuildLeft" not in plan(small)
    rows = small.count()
    conf(**NO_BROADCAST)
    large = learners.learner_modules(star)
    assert "BroadcastHashJoin" not in plan(large)
    assert large.exceptAll(small).isEmpty() and large.count() == rows > 0


def test_a_table_is_not_broadcast_for_its_small_files(spark, star, tmp_path):
    # 400,000 names in some MB of files are over 20 MB as rows, which the driver would have to hold.
    users = spark.range(400_000).select(
        F.concat(F.lit("U"), "id").alias("user_id"), F.lit("Ann").alias("first_name"), F.lit(None).cast("string").alias("email")
    )
    users.write.parquet(str(tmp_path / "DimUser"))
    assert sum(f.stat().st_size for f in (tmp_path / "DimUser").iterdir()) < 10 * 1024 * 1024
    large = parquet_tables(spark, str(tmp_path)).users
    assert not _is_small(large.select("user_id", "first_name"))
    assert _is_small(star.users.select("user_id", "first_name"))


def test_a_left_join_of_hot_parents(spark, rows):
    parents = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, p int")
    children = spark.createDataFrame([("a", 7), ("a", 8), ("c", 9), (None, 9)], "k string, v int")
    assert rows(expand(parents, children, ["k"])) == rows(parents.join(children, ["k"], "left"))


def test_unselected_lists_are_not_computed(star):
    text = plan(programme_report.programme_documents(star, AS_OF, ["id", "courses.course_name"]))
    assert not re.search("Fact|fact_user|DimModule", text)
    text = plan(learner_report.learner_progress_documents(star, None, ["learner_data.name"]))
    assert "FactModule" not in text.split("BroadcastExchange")[0]


def test_nothing_is_kept_on_one_machine():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for file in [*root.glob("cohortlens/**/*.py"), root / "__spark_entry__.py"]:
        text = file.read_text()
        assert not re.search(r"localCheckpoint|\.collect\(\)|toPandas|\.rdd\b|crossJoin", text), file


def test_a_hot_learner_is_split(spark, conf, star):
    conf(
        **NO_BROADCAST,
        **{
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        },
    )
    frames = {name: getattr(star, key) for key, (name, _) in INPUTS.items()}
    name = "FactProgrammePerformanceSnapshot"
    rows = frames[name].withColumn("is_alive", F.lit(False))
    one = rows.filter("user_id = 'U1'").limit(1)
    copies = one.withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).repartition(8)
    copies = copies.withColumn("programme_id", F.sha1(F.col("id").cast("string")))
    frames[name] = rows.unionAll(copies.select(*rows.columns))
    df = programmes.inactive_users(frame_tables(frames))
    df.collect()
    assert "skew=true" in plan(df)


def test_presented_rows_are_not_shuffled(conf, star):
    conf(**NO_BROADCAST)
    lines = plan(learner_report.learner_presentation(star)).splitlines()
    # Modules are read once, course runs for the rows and for the certificates.
    assert sum("FactModulePerformanceSnapshot" in line for line in lines) == 1
    assert sum("FactCoursePerformanceSnapshot" in line for line in lines) == 2
    # Where modules meet their course runs, and in all that follows, nothing is shuffled.
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    depth = [re.search(r"[A-Z]", line).start() for line in lines]
    above = [line for i, line in enumerate(lines[:at]) if depth[i] < min(depth[i + 1 : at + 1])]
    assert above and not any("Exchange" in line for line in above)


def test_the_presented_header_is_known_to_be_small(star):
    # A header of unknown size would be met by the rows, dealt to as many tasks as there are programmes.
    text = plan(learner_report.learner_presentation(star))
    assert not re.search(r"Exchange hashpartitioning\((programme_id|id)#\d+, \d+\)", text)
    assert "/headers-" in text
