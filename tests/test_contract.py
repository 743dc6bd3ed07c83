from datetime import datetime

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import contract
from cohortlens.plans import learner_report, programme_report
from cohortlens.schemas import LEARNER_PROGRESS, PROGRAM

WIDE = {"flag": "int", "int": "long"}
USER = {"user_id": "U1", "first_name": "Ana", "email": "ana@example.org"}
FACT = {"user_id": "U1", "programme_id": "P1", "learner_category": "Ahead"}


def test_contract_sizes():
    assert len(PROGRAM.fields) == 32
    assert len(PROGRAM["courses"].dataType.elementType.fields) == 13
    assert len(LEARNER_PROGRESS.fields) == 9
    learner = LEARNER_PROGRESS["learner_data"].dataType.elementType
    assert sum(not f.nullable for f in learner.fields) == 14 and len(learner.fields) == 15


def test_an_integer_beyond_32_bits_is_an_error(tables, rows):
    offer = {
        "programme_id": "P1",
        "cohort_identifier": "K1",
        "is_valid_offering": 1,
        "program_total_points_defined": 3_000_000_000,
    }
    t = tables(ddl=WIDE, programmes=[{"programme_id": "P1"}], programme_offerings=[offer])
    ansi = t.programmes.sparkSession.conf.get("spark.sql.ansi.enabled")
    for mode in ("true", "false"):
        t.programmes.sparkSession.conf.set("spark.sql.ansi.enabled", mode)
        with pytest.raises(SparkRuntimeException, match="integer out of range"):
            programme_report.programme_documents(t, "1999-01-01", ["total_points"]).collect()
    t.programmes.sparkSession.conf.set("spark.sql.ansi.enabled", ansi)
    found = programme_report.program_violations(t, "1999-01-01")
    assert rows(found) == [("offering", "P1", None, "K1", "total_points", "integer out of range")]


BIG = 3_000_000_000


def test_integers_inside_lists_are_checked(tables, rows):
    run = {
        "programme_id_fk": "P1",
        "cohort_identifier_fk": "K1",
        "cohort_schedule_id": "R1",
        "course_id": "C1",
        "course_order_id": BIG,
        "course_offering_start_timestamp": datetime(1998, 12, 1),
        "course_offering_end_timestamp": datetime(1999, 2, 1),
    }
    module = {"cohort_schedule_id": "R1", "module_id": "M1", "module_order_id": -BIG, "programme_id_fk": "P1"}
    fact = {"user_id": "U1", "cohort_identifier_fk": "R1", "programme_id_fk": "P1"}
    t = tables(
        ddl=WIDE,
        programmes=[{"programme_id": "P1"}],
        users=[USER],
        courses=[{"course_id": "C1", "course_name": "Logic"}],
        modules=[{"module_id": "M1", "module_name": "Sets"}],
        course_offerings=[run],
        module_offerings=[module],
        course_facts=[{**fact, "course_id": "C1"}],
        module_facts=[{**fact, "module_id": "M1"}],
    )
    reason = "integer out of range"
    assert rows(programme_report.program_violations(t, "1999-01-01")) == [
        ("course_certificate", "P1", "Ana", "Logic", "course_order_id", reason),
        ("ongoing_module", "P1", "Ana", "Sets", "course_order_id", reason),
        ("ongoing_module", "P1", "Ana", "Sets", "module_order_id", reason),
    ]


def test_counts_are_checked(tables, rows, monkeypatch):
    t = tables(
        programmes=[{"programme_id": "P1"}],
        programme_offerings=[{"programme_id": "P1", "cohort_identifier": "K1", "is_valid_offering": 1}],
        users=[USER, {**USER, "user_id": "U2"}],
        courses=[{"course_id": "C1", "course_name": "Logic"}],
        course_offerings=[
            {"programme_id_fk": "P1", "cohort_schedule_id": "R1", "course_id": "C1",
             "course_offering_end_timestamp": datetime(1998, 2, 1)}
        ],
        course_facts=[
            {"user_id": "U1", "cohort_identifier_fk": "R1", "programme_id_fk": "P1", "course_id": "C1",
             "is_certificate_earned_course": False}
        ],
        programme_facts=[{**FACT, "user_id": u} for u in ("U1", "U2")],
    )
    # Too few rows here to count beyond 32 bits, so the bounds are drawn in.
    for module in (contract, programme_report):
        monkeypatch.setattr(module, "INT_MAX", 0)
    found = programme_report.program_violations(t, "1999-01-01")
    got = {(r.level, r.user_id, r.field) for r in found.collect()}
    fields = ["learners.total", "learners.active", "learners.pacing.ahead", "laggards_count", "completed_course_count"]
    assert got == {("lagging_course", "Ana", "count"), *(("offering", None, f) for f in fields)}


def test_every_field_of_the_contract_needs_rows(spark):
    df = spark.createDataFrame([(1,)], "n long")
    tree = T.StructType([T.StructField("n", T.IntegerType()),
                         T.StructField("held", T.ArrayType(T.StructType([T.StructField("m", T.IntegerType())])))])
    levels = {"": [contract.Level("top", df, {})]}
    with pytest.raises(ValueError, match="no rows hold m of held"):
        contract.tree_violations(tree, levels)
    levels["held"] = [contract.Level("held", df, {}, {"m": "n"})]
    assert contract.tree_violations(tree, levels).collect() == []


def test_learner_violations(tables, rows):
    t = tables(
        ddl=WIDE,
        programmes=[{"programme_id": "P1", "programme_name": "One"}],
        users=[USER, {"user_id": "U2"}],
        programme_facts=[FACT, {**FACT, "user_id": "U2", "achieved_points": -(2**31) - 1}],
    )
    found = rows(learner_report.learner_violations(t).drop("item_id"))
    assert found == [
        ("learner", "P1", "U2", "achieved_points", "integer out of range"),
        ("learner", "P1", "U2", "email", "null"),
        ("learner", "P1", "U2", "name", "null"),
        ("programme", "P1", None, "status", "null"),
    ]
    good, broken = learner_report.conformed_learners(t)
    assert rows(good, "id", "achieved_points") == [("U1", 0)]
    assert dict(good.dtypes)["achieved_points"] == "int"
    assert rows(broken, "id") == [("U2",)]


def test_columns_that_cannot_fail_are_not_checked(spark):
    df = spark.createDataFrame([(1, 2)], "a int not null, b int")
    assert contract.violations(df, "x", {}, ["a"], ["a", "b"]).collect() == []


def test_shape_must_match(spark):
    df = spark.createDataFrame([(1, "x")], "id int, other string")
    with pytest.raises(TypeError, match="expected the fields"):
        contract.conform(df.select(F.struct("id").alias("duration")), _only("duration"))


def _only(*names):
    return type(PROGRAM)([PROGRAM[n] for n in names])


def test_selection_of_nested_fields(spark):
    df = spark.sql(
        "select 1 as a, named_struct('x', 2, 'y', 3) as s, "
        "array(named_struct('p', 4, 'q', array(named_struct('r', 5, 't', 6))), null) as l, "
        "cast(null as struct<x:int,y:int>) as n"
    )
    picked = contract.select_fields(df, ["l.q.t", "s.y", "n.x", "a"])
    assert picked.columns == ["l", "s", "n", "a"]
    assert picked.first().asDict(recursive=True) == {
        "l": [{"q": [{"t": 6}]}, None],
        "s": {"y": 3},
        "n": None,
        "a": 1,
    }
    assert contract.select_fields(df, ["s.x", "s"]).schema["s"].dataType == df.schema["s"].dataType
    for wrong in ("b", "s.z", "a.x"):
        with pytest.raises(ValueError):
            contract.select_fields(df, [wrong])
