"""Programme blocks.

Nothing here gathers a programme's rows in one place: lists
are returned as rows and nested only by :mod:`cohortlens.operators.nesting`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import moment, rounded
from cohortlens.operators.joins import join_dimensions
from cohortlens.sources.tables import Tables

# Learner categories as they are stored, with the pacing columns that count them.
PACING = {"Ahead": "ahead_count", "On Track": "on_track_count", "Behind": "behind_count"}


def program_modules(t: Tables) -> DataFrame:
    """Module offerings with the module name, if the module is known."""
    return t.module_offerings.drop("module_order_id").join(t.modules, "module_id", "left").select(
        "programme_id_fk",
        "cohort_schedule_id",
        "course_id_fk",
        "module_id",
        "module_name",
        "module_offering_start_timestamp",
        "module_offering_end_timestamp",
        "module_total_points_defined",
        "module_issue_badges_flag",
        "module_badge_percentage",
        "module_allowed_quiz_attempts",
        "module_sla_ita_attendance_points",
        "module_badge_bonus_points",
    )


def program_courses(t: Tables) -> DataFrame:
    """Course offerings that belong to a programme, with the course name if the course is known."""
    return (
        t.course_offerings.filter(F.col("programme_id_fk").isNotNull())
        .join(t.courses, "course_id", "left")
        .select(
            "programme_id_fk",
            "cohort_identifier_fk",
            "course_id",
            "course_name",
            "course_offering_start_timestamp",
            "course_offering_end_timestamp",
            "course_total_points_defined",
            "course_issue_badges_flag",
            "course_badge_percentage",
            "course_allowed_quiz_attempts",
            "course_badge_bonus_points",
            "course_sla_ita_attendance_points",
            "cohort_schedule_id",
            F.coalesce("certificate_pass_percentage", F.lit(0.0)).alias(
                "certificate_pass_percentage"
            ),
        )
    )


def ongoing_course_progress(t: Tables, as_of) -> DataFrame:
    """Distinct badge status per learner name and module in the course runs open at ``as_of``."""
    now = moment(as_of)
    open_runs = t.course_offerings.filter(
        (F.col("course_offering_end_timestamp") > now)
        & (F.col("course_offering_start_timestamp") <= now)
    ).select("programme_id_fk", "cohort_schedule_id", "course_id", "course_order_id")
    facts = t.module_facts.select(
        "user_id",
        "module_id",
        F.col("cohort_identifier_fk").alias("cohort_schedule_id"),
        "is_badge_earned_module",
    )
    offered = t.module_offerings.select("cohort_schedule_id", "module_id", "module_order_id")
    # Facts of open runs are told apart by name before they meet the texts of the dimensions.
    current = facts.join(open_runs.select("cohort_schedule_id").distinct(), "cohort_schedule_id", "left_semi")
    named = current.join(t.users.select("user_id", "first_name"), "user_id").drop("user_id").distinct()
    rows = join_dimensions(
        named,
        [
            (offered, ["cohort_schedule_id", "module_id"]),
            (open_runs, ["cohort_schedule_id"]),
            (t.courses, ["course_id"]),
            (t.modules, ["module_id"]),
        ],
    )
    return (
        rows.select(
            "course_name",
            "course_order_id",
            "module_order_id",
            "module_name",
            "first_name",
            "is_badge_earned_module",
            "programme_id_fk",
        )
        .distinct()
    )


def _distinct_names(members: DataFrame, t: Tables, name: str) -> DataFrame:
    return (
        members.select("programme_id", "user_id")
        .join(t.users.select("user_id", "first_name"), "user_id")
        .filter(F.col("first_name").isNotNull())
        .select("programme_id", F.col("first_name").alias(name))
        .distinct()
    )


def inactive_users(t: Tables) -> DataFrame:
    """Distinct first names, per programme, of the learners marked as not alive."""
    gone = t.programme_facts.filter(F.col("is_alive") == F.lit(False))
    return _distinct_names(gone, t, "inactive_user_name")


def blocked_users(t: Tables) -> DataFrame:
    """Distinct first names, per programme, of the learners whose access is blocked."""
    blocked = t.enrolments.filter(F.col("is_access_blocked_enrolment") == F.lit(True))
    return _distinct_names(blocked, t, "blocked_user_name")


def lagging_users(t: Tables, as_of) -> DataFrame:
    """Per programme and first name, the distinct (run, course) pairs that ended uncertified.

    The run alone links a fact to its offering.  A course without a name makes the pair null, which
    is not counted; the learner is listed all the same.
    """
    ended = t.course_offerings.filter(
        F.col("course_offering_end_timestamp") < moment(as_of)
    ).select(F.col("cohort_schedule_id").alias("cohort_identifier_fk"), "course_id")
    facts = t.course_facts.filter(
        F.col("is_certificate_earned_course") == F.lit(False)
    ).select("programme_id_fk", "cohort_identifier_fk", "user_id")
    late = join_dimensions(facts, [(ended, ["cohort_identifier_fk"]), (t.courses, ["course_id"])])
    run_course = F.concat("cohort_identifier_fk", F.lit("-"), "course_name")
    return (
        late.select("programme_id_fk", "user_id", run_course.alias("run_course"))
        .join(t.users.select("user_id", "first_name"), "user_id")
        .groupBy("programme_id_fk", "first_name")
        .agg(F.countDistinct("run_course").alias("course_records_count"))
    )


def completed_courses(t: Tables) -> DataFrame:
    """Every course offering of a programme, as a bag; there is no test of completion."""
    return (
        t.course_offerings.select("programme_id_fk", "course_id")
        .join(t.courses, "course_id")
        .select(F.col("programme_id_fk").alias("programme_id"), "course_id", "course_name")
    )


def completed_courses_counted(t: Tables) -> DataFrame:
    """:func:`completed_courses` with equal rows counted in ``copies``."""
    rows = completed_courses(t)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def program_metrics(t: Tables) -> DataFrame:
    """Mean progress and engagement per programme, ignoring nulls."""
    return t.programme_facts.groupBy("programme_id").agg(
        rounded(F.avg("progress_percentage")).alias("avg_progress"),
        rounded(F.avg("engagement_score_percentage")).alias("avg_engagement"),
    )


def _per_learner(t: Tables, *extra) -> DataFrame:
    # One row per learner first: distinct counts become plain sums, without one copy of each row
    # per counted column, and a large programme is spread over its learners.
    return t.programme_facts.groupBy("programme_id", "user_id").agg(
        *(F.max(F.col("learner_category") == c).alias(n) for c, n in PACING.items()), *extra
    )


def _pacing_counts() -> list:
    known = F.count("user_id")
    return [
        known.alias("total_learners"),
        known.alias("active_learners"),
        *(F.count(F.when(F.col(n), F.col("user_id"))).alias(n) for n in PACING.values()),
    ]


def learner_pacing(t: Tables) -> DataFrame:
    """Distinct learners per programme, in total and by learner category."""
    return _per_learner(t).groupBy("programme_id").agg(*_pacing_counts())


def programme_rollup(t: Tables) -> DataFrame:
    """:func:`program_metrics` and :func:`learner_pacing` in one pass over the facts."""
    means = {
        "avg_progress": "progress_percentage",
        "avg_engagement": "engagement_score_percentage",
    }
    extra = [F.sum(c).alias(f"{n}_sum") for n, c in means.items()]
    extra += [F.count(c).alias(f"{n}_n") for n, c in means.items()]
    return _per_learner(t, *extra).groupBy("programme_id").agg(
        *_pacing_counts(),
        *(
            rounded(F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_n"))).alias(n)
            for n in means
        ),
    )


def _with_offered_courses(certificates: DataFrame, t: Tables) -> DataFrame:
    offered = t.course_offerings.select("programme_id_fk", "course_id", "course_order_id")
    known = t.programmes.select(F.col("programme_id").alias("programme_id_fk"))
    return join_dimensions(
        certificates,
        [
            (offered, ["programme_id_fk", "course_id"]),
            (t.courses, ["course_id"]),
            (known, ["programme_id_fk"]),
        ],
    )


def _certificates(t: Tables) -> DataFrame:
    return t.course_facts.select(
        "programme_id_fk", "course_id", "user_id", "is_certificate_earned_course"
    ).join(t.users.select("user_id", "first_name"), "user_id")


def user_cert_status(t: Tables) -> DataFrame:
    """Certificate status per learner, course and offering, as a bag.

    Offerings are found by (programme, course), so a course that runs twice gives two rows per fact.
    """
    return _with_offered_courses(_certificates(t), t).select(
        "course_order_id",
        "course_name",
        "first_name",
        "is_certificate_earned_course",
        "programme_id_fk",
    )


def user_cert_status_counted(t: Tables) -> DataFrame:
    """:func:`user_cert_status` with equal rows of a course counted in ``copies``.

    Facts are counted by name before they meet the offerings, so neither that join nor a large
    programme sees one row per learner.
    """
    facts = ["programme_id_fk", "course_id", "first_name", "is_certificate_earned_course"]
    counted = _certificates(t).groupBy(*facts).agg(F.count("*").alias("copies"))
    return _with_offered_courses(counted, t).drop("course_id")
