import pathlib
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortlens.schemas import INPUTS
from cohortlens.session import SHARED_FOLDER, partitions_for, shared_folder, size_shuffles
from cohortlens.sinks import expire, read_documents, snapshot, write_documents, write_report, write_tables
from cohortlens.sources import (
    catalog_tables,
    derived_tables,
    frame_tables,
    parquet_tables,
    stored_tables,
    tables_by_programme,
)
from cohortlens.sources.derived import RAW_TABLES

SF = "/root/testdata/sf0.001"
# Row counts of the derived tables at the smallest scale.
COUNTS = {
    "programmes": 25,
    "programme_offerings": 28,
    "courses": 5,
    "course_offerings": 10,
    "modules": 196,
    "module_offerings": 200,
    "users": 150,
    "programme_facts": 847,
    "course_facts": 945,
    "module_facts": 4981,
    "enrolments": 150,
}


def test_derived_and_materialised_tables_agree(spark, tmp_path):
    derived = derived_tables(spark, SF)
    write_tables(derived, str(tmp_path))
    stored = parquet_tables(spark, str(tmp_path))
    for key, n in COUNTS.items():
        assert getattr(derived, key).count() == n, key
        assert getattr(stored, key).schema.names == list(INPUTS[key][1])
        assert getattr(stored, key).exceptAll(getattr(derived, key)).isEmpty(), key
        assert getattr(stored, key).count() == n


def test_stored_tables_follow_their_raw_files(spark, tmp_path):
    for name in RAW_TABLES:
        raw = pathlib.Path(f"{SF}/{name}.parquet")
        (tmp_path / raw.name).write_bytes(raw.read_bytes())
    first = stored_tables(spark, str(tmp_path)).courses
    assert first.count() == 5 and stored_tables(spark, str(tmp_path)).courses.inputFiles() == (
        first.inputFiles()
    )
    changed = tmp_path / "supplier.parquet"
    changed.write_bytes(pathlib.Path("/root/testdata/sf0.01/supplier.parquet").read_bytes())
    spark.catalog.refreshByPath(str(tmp_path))
    assert stored_tables(spark, str(tmp_path)).courses.count() == 50
    assert first.count() == 5


def test_catalog_tables(spark):
    spark.createDataFrame([("C1", "Logic")], "course_id string, course_name string").write.mode(
        "overwrite"
    ).saveAsTable("DimCourse")
    try:
        assert catalog_tables(spark, "default").courses.collect() == [("C1", "Logic")]
    finally:
        spark.sql("DROP TABLE DimCourse")


def test_missing_columns_and_wrong_types_are_named(spark):
    t = frame_tables({"DimCourse": spark.createDataFrame([("C1",)], "course_id string")})
    with pytest.raises(ValueError, match="DimCourse lacks the columns course_name"):
        t.courses
    wrong = spark.createDataFrame([(1, "x")], "course_id int, course_name string")
    with pytest.raises(TypeError, match="DimCourse, column course_id: expected string"):
        frame_tables({"DimCourse": wrong}).courses
    with pytest.raises(AttributeError):
        t.lessons


def test_close_types_are_converted(spark):
    columns = INPUTS["programme_facts"][1]
    given = {"last_active": "timestamp_ntz", "progress_percentage": "float", "achieved_points": "short"}
    schema = ", ".join(f"{c} {given.get(c, k)}" for c, k in columns.items())
    t = frame_tables({"FactProgrammePerformanceSnapshot": spark.createDataFrame([], schema)})
    found = dict(t.programme_facts.dtypes)
    assert [found[c] for c in given] == ["timestamp", "double", "int"]


def test_one_programme_reaches_every_scan(spark, tmp_path):
    write_tables(derived_tables(spark, SF), str(tmp_path), ["course_facts", "users"])
    one = parquet_tables(spark, str(tmp_path)).for_programme("P3")
    assert {r[0] for r in one.course_facts.select("programme_id_fk").distinct().collect()} == {"P3"}
    plan = one.course_facts._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(programme_id_fk,P3)" in plan
    assert one.users.count() == 150


def test_report_in_partitions(spark, tmp_path):
    df = spark.range(10).withColumn("programme_id", F.concat(F.lit("P"), F.col("id") % 2))
    write_report(df, str(tmp_path / "r"), ["programme_id"])
    stored = spark.read.parquet(str(tmp_path / "r")).filter("programme_id = 'P1'")
    assert stored.count() == 5
    assert "PartitionFilters: [isnotnull(programme_id" in stored._jdf.queryExecution().toString()


def test_snapshot_is_reused_for_less_than_300_seconds(spark, tmp_path):
    path, start, built = str(tmp_path / "s"), datetime(1999, 1, 1), []

    def ask(seconds):
        def build():
            built.append(seconds)
            return spark.createDataFrame([(seconds,)], "made long")

        return snapshot(spark, path, start + timedelta(seconds=seconds), build).first().made

    assert ask(0) == 0 and ask(0) == 0 and ask(299.999) == 0
    assert ask(300) == 300
    # The newest fresh one serves; none serves a moment before its own.
    assert ask(301) == 300 and ask(150) == 0 and ask(-1) == -1
    assert built == [0, 300, -1]


def test_unfinished_snapshot_is_rebuilt(spark, tmp_path):
    path, now = str(tmp_path / "s"), "1999-01-01 00:00:00"
    snapshot(spark, path, now, lambda: spark.range(3))
    [marker] = (tmp_path / "s").glob("*/_SUCCESS")
    marker.unlink()
    assert snapshot(spark, path, now, lambda: spark.range(5)).count() == 5


def test_one_programme_reads_its_own_files(spark):
    def files_read(df):
        [scan] = leaves(df._jdf.queryExecution().executedPlan())
        return scan.selectedPartitions().totalNumberOfFiles()

    def leaves(plan):
        found = plan.collectLeaves()
        return [found.apply(i) for i in range(found.size())]

    t, plain = tables_by_programme(spark, SF), stored_tables(spark, SF)
    some = plain.programme_facts.first().programme_id
    for key in ("programme_facts", "course_facts", "module_facts"):
        whole, one = getattr(t, key), getattr(t.for_programme(some), key)
        assert 0 < files_read(one) < files_read(whole) / 4
        assert whole.exceptAll(getattr(plain, key)).isEmpty() and whole.count() == getattr(plain, key).count()
        assert one.exceptAll(getattr(plain.for_programme(some), key)).isEmpty()
        assert one.count() == getattr(plain.for_programme(some), key).count()
    assert t.for_programme("none").module_facts.count() == 0


def test_two_writers_at_once_leave_one_whole_snapshot(spark, tmp_path):
    path, now, inner = str(tmp_path / "s"), "1999-01-01 00:00:00", []

    def build():
        # While the first one writes, a second one publishes for the same moment.
        if not inner:
            inner.append(True)
            inner.append(snapshot(spark, path, now, lambda: spark.range(7)).count())
        return spark.range(5)

    first = snapshot(spark, path, now, build)
    again = snapshot(spark, path, now, lambda: spark.range(9))
    assert inner == [True, 7]
    # Whoever's it is, it is whole and the same for all from now on.
    assert first.count() == again.count() in (5, 7)
    assert first.inputFiles() == again.inputFiles()


def test_a_writer_that_fails_publishes_nothing(spark, tmp_path):
    path, now = str(tmp_path / "s"), "1999-01-01 00:00:00"
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        snapshot(spark, path, now, lambda: broken)
    assert snapshot(spark, path, now, lambda: spark.range(4)).count() == 4


def test_old_snapshots_expire(spark, tmp_path):
    path, start = str(tmp_path / "s"), datetime(1999, 1, 1, tzinfo=UTC)
    for minutes in (0, 10, 20):
        snapshot(spark, path, start + timedelta(minutes=minutes), lambda: spark.range(3))
    (tmp_path / "s" / "data_19981201T000000.000000Z-left").mkdir()
    assert expire(spark, path, start + timedelta(minutes=21)) == 3
    assert len([p for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")]) == 2
    assert snapshot(spark, path, start + timedelta(minutes=21), lambda: spark.range(9)).count() == 3


def test_documents_and_their_manifest(spark, tmp_path):
    rows = [("a", 0, [1, 2]), ("a", 1, [3]), ("b", 0, []), (None, 0, [4])]
    df = spark.createDataFrame(rows, "id string, part long, items array<int>")
    path = str(tmp_path / "d")
    write_documents(df, path, ["id"])
    assert sorted(map(tuple, read_documents(spark, path, ["id"]).collect()), key=repr) == sorted(rows, key=repr)
    for lost in ("id = 'a' and part = 1", "id is null"):
        broken = str(tmp_path / lost.replace(" ", "_"))
        write_documents(df, broken, ["id"])
        spark.read.parquet(f"{path}/parts").where(f"not coalesce({lost}, false)").write.mode("overwrite").parquet(f"{broken}/parts")
        with pytest.raises(ValueError, match="do not match"):
            read_documents(spark, broken, ["id"])
    write_documents(df.where("part = 1"), str(tmp_path / "e"), ["id"])
    with pytest.raises(ValueError, match="lack parts"):
        read_documents(spark, str(tmp_path / "e"), ["id"])


def test_shared_folder_is_the_named_one():
    def session(folder, master):
        context = SimpleNamespace(master=master, applicationId="app-1")
        conf = SimpleNamespace(get=lambda key, default: {SHARED_FOLDER: folder}.get(key) or default)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_folder(session("s3a://bucket/shared/", "yarn")) == "s3a://bucket/shared"
    made = shared_folder(session(None, "local[2]"))
    assert made and shared_folder(session(None, "local[2]")) == made
    with pytest.raises(ValueError, match=SHARED_FOLDER):
        shared_folder(session(None, "yarn"))


def test_shuffles_are_sized_by_the_input(spark, tmp_path, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "data").write_bytes(b"x" * 1000)
    assert spark.conf.get(key, None) is None
    monkeypatch.setattr("cohortlens.session.BYTES_PER_PARTITION", 10)
    size_shuffles(spark, str(tmp_path))
    assert spark.conf.get(key) == "100"
    monkeypatch.setattr("cohortlens.session.BYTES_PER_PARTITION", 100)
    size_shuffles(spark, str(tmp_path))
    assert spark.conf.get(key) == "10"
    monkeypatch.undo()
    size_shuffles(spark, str(tmp_path))
    assert spark.conf.get(key, None) is None
    try:
        spark.conf.set(key, "77")
        size_shuffles(spark, str(tmp_path))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)


def test_shuffles_of_any_size_have_small_partitions():
    for size in (1, 10**9, 100 * 10**12):
        assert size / partitions_for(size) <= 256 * 1024 * 1024


def test_tasks_of_a_large_input_stay_small(spark, tables):
    tables()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    for size in (10**9, 6 * 10**9, 100 * 10**12):
        assert size / partitions_for(size) <= 32 * 1024 * 1024


def test_dealt_rows_of_a_large_input_fit_in_a_task(spark, tables):
    tables()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"
    # The learner report deals some five times its raw files.
    for size in (10**9, 6 * 10**9, 100 * 10**12):
        assert 5 * size / partitions_for(size) <= 40 * 1024 * 1024


def test_local_times_are_in_utc(spark):
    import datetime as dt

    from cohortlens.sources.tables import conform_input

    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.5' as a, date'2024-03-10' as b")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = conform_input(df, "t", {"a": "timestamp", "b": "timestamp"})
        micros = got.select(F.unix_micros("a"), F.unix_micros("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    start = int(dt.datetime(2024, 3, 10, tzinfo=dt.UTC).timestamp()) * 10**6
    assert tuple(micros) == (start + 9_000_500_000, start)


def test_folders_of_one_name_have_their_own_snapshots(spark, tmp_path):
    import __spark_entry__ as entry

    names = []
    for parent, scale in (("a", "sf0.001"), ("b", "sf0.01")):
        folder = tmp_path / parent / "sf"
        folder.mkdir(parents=True)
        for name in RAW_TABLES:
            raw = pathlib.Path(f"/root/testdata/{scale}/{name}.parquet")
            (folder / raw.name).write_bytes(raw.read_bytes())
        names.append(str(folder))
    query = entry.queries()["programs_snapshot"]
    first, second = (query(spark, name).inputFiles() for name in names)
    assert not set(first) & set(second)
