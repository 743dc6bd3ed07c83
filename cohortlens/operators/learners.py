"""Learner blocks, for all programmes at once.

Each table keeps ``programme_id``; filter on it, or start from ``Tables.for_programme``, to get the
answer for one programme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import rounded, zero_if_null
from cohortlens.operators.joins import join_dimensions
from cohortlens.sources.tables import Tables


def programme_info(t: Tables) -> DataFrame:
    """Programmes with each of their offerings, valid or not, and the badges of all their runs."""
    badges = t.course_offerings.groupBy(F.col("programme_id_fk").alias("programme_id")).agg(
        F.sum("total_badges").alias("total_badges")
    )
    offerings = t.programme_offerings.select(
        "programme_id", "offering_status", "defined_total_course_certificates"
    )
    return (
        t.programmes.join(offerings, "programme_id", "left")
        .join(badges, "programme_id", "left")
        .withColumn("total_badges", zero_if_null("total_badges"))
    )


def programme_performance(t: Tables) -> DataFrame:
    """Counts of completed and distinguished snapshots, and mean performance with nulls as 0."""
    return t.programme_facts.groupBy("programme_id").agg(
        F.count(F.when(F.col("completion_status"), 1)).alias("completion_certificates"),
        F.count(F.when(F.col("distinction_status"), 1)).alias("distinction_certificates"),
        rounded(F.avg(F.coalesce("performance_score_percentage", F.lit(0.0)))).alias("performance"),
    )


def _score(column: str, name: str):
    return F.coalesce(rounded(F.col(column)), F.lit(0.0)).alias(name)


def learner_modules(t: Tables) -> DataFrame:
    """One row per learner, module and course run, with the settings of the module offering."""
    run = ["programme_id_fk", "module_id", "cohort_schedule_id"]
    offered = t.module_offerings.drop("course_id_fk", "module_order_id")
    facts = t.module_facts.withColumnRenamed("cohort_identifier_fk", "cohort_schedule_id")
    return (
        join_dimensions(facts, [(offered, run), (t.modules, ["module_id"])])
        .select(
            F.col("programme_id_fk").alias("programme_id"),
            "cohort_schedule_id",
            "user_id",
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
            _score("engagement_score_module_percentage", "engagement"),
            _score("progress_percentage_module", "progress"),
            _score("performance_score_module_percentage", "performance"),
            F.coalesce("is_badge_earned_module", F.lit(False)).alias("badge"),
            zero_if_null("earned_bonus_points_module").alias("bonus_points"),
            zero_if_null("time_spent_seconds_module").alias("time_spent_seconds_module"),
            zero_if_null("achieved_points_module").alias("achieved_points"),
        )
    )


def learner_courses(t: Tables) -> DataFrame:
    """One row per learner and course run, with the settings of the course offering."""
    run = ["programme_id_fk", "course_id", "cohort_schedule_id"]
    offered = t.course_offerings.drop("cohort_identifier_fk", "course_order_id")
    facts = t.course_facts.withColumnRenamed("cohort_identifier_fk", "cohort_schedule_id")
    return (
        join_dimensions(facts, [(offered, run), (t.courses, ["course_id"])])
        .select(
            F.col("programme_id_fk").alias("programme_id"),
            "user_id",
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
            "certificate_pass_percentage",
            "total_badges",
            _score("progress_percentage_course", "progress"),
            _score("engagement_score_course_percentage", "engagement"),
            _score("performance_score_course_percentage", "performance"),
            F.coalesce("is_certificate_earned_course", F.lit(False)).alias("certificate_earned"),
            zero_if_null("time_spent_seconds_course").alias("time_spent_seconds_course"),
            zero_if_null("achieved_points_course").alias("achieved_points"),
        )
    )


def learner_data(t: Tables) -> DataFrame:
    """One row per learner snapshot, with the number of certified course runs."""
    certified = (
        t.course_facts.filter(F.col("is_certificate_earned_course"))
        .groupBy(F.col("programme_id_fk").alias("programme_id"), "user_id")
        .agg(F.count("*").alias("course_certificates_earned"))
    )
    return (
        t.programme_facts.drop("is_alive")
        .join(t.users, "user_id")
        .join(certified, ["programme_id", "user_id"], "left")
        .select(
            "programme_id",
            "user_id",
            F.col("first_name").alias("name"),
            "email",
            F.col("learner_category").alias("status"),
            _score("progress_percentage", "progress"),
            _score("engagement_score_percentage", "engagement"),
            _score("performance_score_percentage", "performance"),
            zero_if_null("time_spent_seconds").alias("time_spent_seconds"),
            zero_if_null("achieved_points").alias("achieved_points"),
            zero_if_null("badges_earned_count").alias("badges"),
            zero_if_null("total_unlocked_course_points_in_programme").alias("total_points"),
            F.when(F.col("completion_status"), 1).otherwise(0).alias("completion_certificate"),
            F.when(F.col("distinction_status"), 1).otherwise(0).alias("distinction_certificate"),
            zero_if_null("course_certificates_earned").alias("course_certificates_earned"),
            "last_active",
        )
    )
