from datetime import datetime, timedelta

from conftest import AS_OF

from cohortlens.operators import programmes as ops
from cohortlens.plans import programme_report as report

DAY = timedelta(days=1)
P = {"programme_id": "P1", "programme_name": "One"}
OFFER = {
    "programme_id": "P1",
    "cohort_identifier": "K1",
    "is_valid_offering": 1,
    "offering_start_timestamp": AS_OF - 10 * DAY,
    "offering_end_timestamp": AS_OF + 4 * DAY,
    "updated_on_timestamp": datetime(1998, 3, 4),
}
RUN = {
    "programme_id_fk": "P1",
    "cohort_identifier_fk": "K1",
    "cohort_schedule_id": "R1",
    "course_id": "C1",
    "course_order_id": 1,
    "course_offering_start_timestamp": AS_OF - 30 * DAY,
    "course_offering_end_timestamp": AS_OF - DAY,
}
COURSE = {"course_id": "C1", "course_name": "Logic"}
ANA, EVE = ({"user_id": u, "first_name": n} for u, n in (("U1", "Ana"), ("U2", "Eve")))
CERT = {
    "user_id": "U1",
    "programme_id_fk": "P1",
    "cohort_identifier_fk": "R1",
    "course_id": "C1",
    "is_certificate_earned_course": False,
}


def snapshot_row(user, **values):
    return {"user_id": user, "programme_id": "P1", **values}


def documents(t, **options):
    return [r.asDict(recursive=True) for r in report.programme_documents(t, AS_OF, **options).collect()]


def test_namesakes_merge_and_null_names_are_dropped(tables, rows):
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER],
        users=[ANA, {"user_id": "U2", "first_name": "Ana"}, {"user_id": "U3"}],
        programme_facts=[snapshot_row(u, is_alive=False) for u in ("U1", "U2", "U3")],
        enrolments=[
            {"user_id": u, "programme_id": "P1", "is_access_blocked_enrolment": b}
            for u, b in (("U1", True), ("U2", None), ("U3", True))
        ],
    )
    assert rows(ops.inactive_users(t)) == [("P1", "Ana")]
    assert rows(ops.blocked_users(t)) == [("P1", "Ana")]
    [doc] = documents(t)
    assert (doc["is_alive"], doc["is_alive_list"]) == (1, ["Ana"])
    assert (doc["access_blocked"], doc["access_blocked_list"]) == (1, ["Ana"])


def test_offering_without_courses_lists_one_empty_course(tables):
    [doc] = documents(tables(programmes=[P], programme_offerings=[OFFER]))
    [course] = doc["courses"]
    assert course.pop("modules") == []
    assert len(course) == 12 and set(course.values()) == {None}
    assert len(doc) == 33 and doc["part"] == 0
    assert doc["duration"] == {
        "start": "22 Dec, 1998",
        "end": "05 Jan, 1999",
        "time_elapsed": 71.4,
        "remaining_time": "4 days of total 2 weeks",
    }
    assert doc["last_updated"] == "04 Mar, 1998"
    assert doc["learners"] == {"total": 0, "active": 0, "pacing": dict(ahead=0, on_track=0, behind=0)}
    assert doc["progress"] == doc["engagement"] == 0.0
    assert doc["is_valid"] is True


def test_course_run_twice_multiplies_certificate_status(tables, rows):
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER],
        courses=[COURSE],
        course_offerings=[RUN, {**RUN, "cohort_schedule_id": "R2"}],
        users=[ANA],
        course_facts=[{**CERT, "is_certificate_earned_course": True}],
    )
    assert rows(ops.user_cert_status(t)) == [(1, "Logic", "Ana", True, "P1")] * 2
    [doc] = documents(t)
    assert len(doc["programme_user_cert_status_list"]) == 2
    assert doc["completed_course_count"] == len(doc["completed_courses_list"]) == 2
    assert [c["cohort_schedule_id"] for c in doc["courses"]] == ["R1", "R2"]
    [flat] = report.programs(t, AS_OF).collect()
    assert (flat.cert_status_count, flat.completed_course_count, flat.course_count) == (2, 2, 2)


def test_certificate_status_needs_a_known_programme(tables, rows):
    t = tables(courses=[COURSE], course_offerings=[RUN], users=[ANA], course_facts=[CERT])
    assert rows(ops.user_cert_status(t)) == []
    assert rows(ops.user_cert_status_counted(t)) == []


def test_lagging_counts_run_and_course_pairs(tables, rows):
    t = tables(
        courses=[COURSE, {"course_id": "C2"}],
        course_offerings=[RUN, {**RUN, "cohort_schedule_id": "R2", "course_id": "C2"}],
        users=[ANA, EVE],
        course_facts=[
            CERT,
            CERT,
            {**CERT, "course_id": "another"},
            {**CERT, "user_id": "U2", "cohort_identifier_fk": "R2"},
            {**CERT, "user_id": "U2", "is_certificate_earned_course": None},
        ],
    )
    # The fact's own course plays no part, and a course without a name is listed but not counted.
    assert rows(ops.lagging_users(t, AS_OF)) == [("P1", "Ana", 1), ("P1", "Eve", 0)]


def test_boundaries_of_now(tables, rows):
    def run(name, start, end):
        return {
            **RUN,
            "cohort_schedule_id": name,
            "course_offering_start_timestamp": start,
            "course_offering_end_timestamp": end,
        }

    names = ("ends now", "starts now", "open", "ended", "later")
    t = tables(
        courses=[COURSE],
        course_offerings=[
            run("ends now", AS_OF - DAY, AS_OF),
            run("starts now", AS_OF, AS_OF + DAY),
            run("open", AS_OF - DAY, AS_OF + DAY),
            run("ended", AS_OF - DAY, AS_OF - timedelta(microseconds=1)),
            run("later", AS_OF + DAY, AS_OF + 2 * DAY),
        ],
        modules=[{"module_id": n, "module_name": n} for n in names],
        module_offerings=[{"cohort_schedule_id": n, "module_id": n} for n in names],
        users=[ANA],
        module_facts=[
            {"user_id": "U1", "cohort_identifier_fk": n, "module_id": n} for n in names
        ],
        course_facts=[{**CERT, "cohort_identifier_fk": n} for n in names],
    )
    ongoing = ops.ongoing_course_progress(t, AS_OF)
    assert rows(ongoing, "module_name") == [("open",), ("starts now",)]
    assert rows(ops.lagging_users(t, AS_OF), "course_records_count") == [(1,)]


def test_ongoing_is_distinct_by_name(tables, rows):
    run = {**RUN, "course_offering_end_timestamp": AS_OF + DAY}
    t = tables(
        courses=[COURSE],
        course_offerings=[run],
        modules=[{"module_id": "M1", "module_name": "Sets"}],
        module_offerings=[{"cohort_schedule_id": "R1", "module_id": "M1", "module_order_id": 7}],
        users=[ANA, {"user_id": "U2", "first_name": "Ana"}, {"user_id": "U3"}],
        module_facts=[
            {"user_id": u, "cohort_identifier_fk": "R1", "module_id": "M1", "is_badge_earned_module": b}
            for u, b in (("U1", True), ("U2", True), ("U3", None), ("U1", False))
        ],
    )
    assert rows(ops.ongoing_course_progress(t, AS_OF)) == [
        ("Logic", 1, 7, "Sets", "Ana", False, "P1"),
        ("Logic", 1, 7, "Sets", "Ana", True, "P1"),
        ("Logic", 1, 7, "Sets", None, None, "P1"),
    ]


def test_only_offerings_valid_as_one(tables, rows):
    valid = [{**OFFER, "cohort_identifier": f"K{v}", "is_valid_offering": v} for v in (0, 1, 2, None)]
    t = tables(programmes=[P, {"programme_id": "P2"}], programme_offerings=valid)
    assert rows(report.programs(t, AS_OF), "id", "cohort") == [("P1", "K1")]


def test_validity_may_be_a_boolean(tables, rows):
    offers = [{**OFFER, "cohort_identifier": str(v), "is_valid_offering": v} for v in (True, False)]
    t = tables(ddl={"flag": "boolean"}, programmes=[P], programme_offerings=offers)
    assert rows(report.programs(t, AS_OF), "cohort", "is_valid") == [("True", True)]


def test_run_without_programme(tables, rows):
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER],
        courses=[COURSE],
        course_offerings=[{**RUN, "programme_id_fk": None}],
    )
    assert rows(ops.program_courses(t)) == []
    assert rows(ops.completed_courses(t)) == [(None, "C1", "Logic")]
    [doc] = documents(t)
    assert doc["completed_course_count"] == 0 and doc["completed_courses_list"] == []


def test_unknown_names_stay_null(tables, rows):
    t = tables(
        course_offerings=[RUN],
        module_offerings=[
            {"programme_id_fk": "P1", "cohort_schedule_id": "R1", "course_id_fk": "C1", "module_id": "M"}
        ],
    )
    assert rows(ops.program_modules(t), "module_id", "module_name") == [("M", None)]
    assert rows(ops.program_courses(t), "course_id", "course_name") == [("C1", None)]
    assert rows(ops.program_courses(t), "certificate_pass_percentage") == [(0.0,)]


def test_pacing_counts_learners_once(tables, rows):
    facts = [
        snapshot_row("U1", learner_category="Ahead"),
        snapshot_row("U1", learner_category="Ahead"),
        snapshot_row("U1", learner_category="Behind"),
        snapshot_row("U2", learner_category="On Track"),
        snapshot_row("U3", learner_category=None),
        snapshot_row("U4", learner_category="elsewhere"),
        snapshot_row(None, learner_category="Ahead"),
    ]
    t = tables(programme_facts=facts)
    assert rows(ops.learner_pacing(t)) == [("P1", 4, 4, 1, 1, 1)]
    assert rows(ops.programme_rollup(t).drop("avg_progress", "avg_engagement")) == [
        ("P1", 4, 4, 1, 1, 1)
    ]


def test_means_ignore_nulls(tables, rows):
    facts = [snapshot_row("U1", progress_percentage=100.0), snapshot_row("U2")]
    t = tables(programme_facts=facts)
    assert rows(ops.program_metrics(t)) == [("P1", 100.0, None)]
    assert rows(ops.programme_rollup(t), "avg_progress", "avg_engagement") == [(100.0, None)]


def test_courses_belong_to_their_cohort_and_modules_to_their_run(tables):
    module = {"programme_id_fk": "P1", "course_id_fk": "C1", "module_id": "M1"}
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER, {**OFFER, "cohort_identifier": "K2"}],
        courses=[COURSE],
        course_offerings=[
            RUN,
            {**RUN, "cohort_schedule_id": "R2", "cohort_identifier_fk": "K2"},
            {**RUN, "cohort_schedule_id": None, "cohort_identifier_fk": "K2"},
        ],
        modules=[{"module_id": "M1", "module_name": "Sets"}],
        module_offerings=[
            {**module, "cohort_schedule_id": "R1"},
            {**module, "cohort_schedule_id": "R2", "module_id": "M2"},
            {**module, "cohort_schedule_id": None},
        ],
    )
    found = {
        d["cohort"]: [(c["cohort_schedule_id"], [m["module_id"] for m in c["modules"]]) for c in d["courses"]]
        for d in documents(t)
    }
    assert found == {"K1": [("R1", ["M1"])], "K2": [(None, []), ("R2", ["M2"])]}


def test_equal_offerings_merge_and_repeat_their_courses(tables):
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER, OFFER, {**OFFER, "category": "other"}],
        courses=[COURSE],
        course_offerings=[RUN],
    )
    docs = documents(t)
    assert sorted((d["category"] or "", len(d["courses"])) for d in docs) == [("", 2), ("other", 1)]
    flat = report.programs(t, AS_OF).collect()
    assert sorted((r.category or "", r.course_count) for r in flat) == [("", 2), ("other", 1)]


def test_offering_without_cohort(tables):
    t = tables(
        programmes=[P],
        programme_offerings=[{**OFFER, "cohort_identifier": None}],
        courses=[COURSE],
        course_offerings=[{**RUN, "cohort_identifier_fk": None}],
    )
    [doc] = documents(t)
    assert [c["course_id"] for c in doc["courses"]] == [None]
    assert doc["completed_course_count"] == 1


def test_selected_fields_are_the_only_ones(tables):
    t = tables(programmes=[P], programme_offerings=[OFFER], courses=[COURSE], course_offerings=[RUN])
    [doc] = documents(t, fields=["id", "duration.end", "courses.course_name"])
    assert doc == {
        "part": 0,
        "id": "P1",
        "duration": {"end": "05 Jan, 1999"},
        "courses": [{"course_name": "Logic"}],
    }
    [doc] = documents(t, fields=["completed_course_count", "learners.total"])
    assert doc == {"part": 0, "completed_course_count": 1, "learners": {"total": 0}}


def test_lists_in_parts_hold_everything(tables):
    users = [{"user_id": f"U{i}", "first_name": f"N{i % 40}"} for i in range(200)]
    t = tables(
        programmes=[P],
        programme_offerings=[OFFER, {**OFFER, "cohort_identifier": "K2"}],
        courses=[COURSE],
        course_offerings=[RUN],
        users=users,
        programme_facts=[snapshot_row(u["user_id"], is_alive=False) for u in users],
        course_facts=[{**CERT, "user_id": u["user_id"]} for u in users],
    )
    whole = {d["cohort"]: d for d in documents(t)}
    split = documents(t, part_size=16)
    assert len(whole) == 2 and len(split) > 20
    for cohort, doc in whole.items():
        mine = [d for d in split if d["cohort"] == cohort]
        assert len({d["part"] for d in mine}) == len(mine)
        for field, value in doc.items():
            if isinstance(value, list):
                parts = [e for d in mine for e in d[field]]
                assert sorted(map(repr, parts)) == sorted(map(repr, value)), field
            elif field != "part":
                assert {repr(d[field]) for d in mine} == {repr(value)}, field
        sizes = [sum(len(v) for v in d.values() if isinstance(v, list)) for d in mine]
        assert max(sizes) <= 2 * 16
    assert len(whole["K1"]["programme_user_cert_status_list"]) == 200
    assert whole["K1"]["laggards_count"] == len(whole["K1"]["lagging_courses_list"]) == 40
