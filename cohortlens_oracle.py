"""DuckDB SQL that answers each registered query on its own, for comparison with Spark.

The statements start from the same derivation recipes and then compute the answer another way than
the product where SQL offers one: correlated subqueries where Spark pre-aggregates, joins in another
order, exact row expansion where Spark nests and flattens.
"""

from __future__ import annotations

import re

from cohortlens.sources.derived import RECIPES, inputs_of

AS_OF = "1999-01-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"


def _r(x: str, places: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(18,6)),{places}) AS DOUBLE)"


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') || '+00'"


def _date(x: str) -> str:
    return f"strftime({x}, '%d %b, %Y')"


def _time(x: str) -> str:
    s = f"COALESCE({x},0)"
    return f"printf('%02d:%02d:%02d', {s}//3600, ({s}%3600)//60, {s}%60)"


def _span(days: str) -> str:
    w, d = f"CAST(FLOOR({days}/7.0) AS BIGINT)", f"(({days}%7)+7)%7"
    weeks = f"(CAST({w} AS VARCHAR) || CASE {w} WHEN 1 THEN ' week' ELSE ' weeks' END)"
    rest = f"(CAST({d} AS VARCHAR) || CASE {d} WHEN 1 THEN ' day' ELSE ' days' END)"
    return f"CASE WHEN {d}=0 THEN {weeks} WHEN {w}=0 THEN {rest} ELSE {weeks}||' '||{rest} END"


def _days(later: str, earlier: str) -> str:
    return f"CAST(FLOOR((epoch_us({later})-epoch_us({earlier}))/86400000000) AS BIGINT)"


def _elapsed(start: str, end: str) -> str:
    total = _days(end, start)
    share = _r(f"100.0*{_days(NOW, start)}/{total}", 1)
    return (
        f"CASE WHEN {start} IS NULL OR {end} IS NULL THEN NULL WHEN {NOW}>{end} THEN 100.0 "
        f"WHEN {total}<=0 THEN 0.0 ELSE {share} END"
    )


def _remaining(start: str, end: str) -> str:
    left = f"CASE WHEN {NOW}>{end} THEN 0 ELSE {_days(end, NOW)} END"
    return f"{_span(f'({left})')} || ' of total ' || {_span(_days(end, start))}"


def _with_inputs(sql: str, **extra: str) -> str:
    """Prefix the derivations (and ``extra`` named statements) that the statement uses."""
    ordered: list[tuple[str, str]] = []

    def need(text: str) -> None:
        for name in [*RECIPES, *extra]:
            if re.search(rf"\b{name}\b", text) and name not in dict(ordered):
                if name in RECIPES:
                    body = RECIPES[name]
                    body = body.format(**{i: i for i in inputs_of(name)})
                else:
                    body = extra[name]
                need(re.sub(rf"\b{name}\b", "", body))
                if name not in dict(ordered):
                    ordered.append((name, body))

    need(sql)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in ordered) + " " + sql


# --- programme blocks ---------------------------------------------------------------------------

MODULE_SETTINGS = (
    "module_total_points_defined, module_issue_badges_flag, module_badge_percentage, "
    "module_allowed_quiz_attempts, module_sla_ita_attendance_points, module_badge_bonus_points"
)
COURSE_SETTINGS = (
    "course_total_points_defined, course_issue_badges_flag, course_badge_percentage, "
    "course_allowed_quiz_attempts, course_badge_bonus_points, course_sla_ita_attendance_points"
)

BLOCKS = {
    "program_modules": f"""
        SELECT programme_id_fk, cohort_schedule_id, course_id_fk, module_id,
               (SELECT module_name FROM DimModule d WHERE d.module_id = s.module_id) AS module_name,
               {_ts('module_offering_start_timestamp')} AS module_offering_start_timestamp,
               {_ts('module_offering_end_timestamp')} AS module_offering_end_timestamp,
               {MODULE_SETTINGS}
        FROM DimModuleOffering s""",
    "program_courses": f"""
        SELECT programme_id_fk, cohort_identifier_fk, course_id,
               (SELECT course_name FROM DimCourse d WHERE d.course_id = r.course_id) AS course_name,
               {_ts('course_offering_start_timestamp')} AS course_offering_start_timestamp,
               {_ts('course_offering_end_timestamp')} AS course_offering_end_timestamp,
               {COURSE_SETTINGS}, cohort_schedule_id,
               IFNULL(certificate_pass_percentage, 0) AS certificate_pass_percentage,
               (SELECT COUNT(*) FROM DimModuleOffering s
                WHERE (s.programme_id_fk, s.cohort_schedule_id, s.course_id_fk)
                    = (r.programme_id_fk, r.cohort_schedule_id, r.course_id)) AS module_count
        FROM DimCourseOffering r WHERE programme_id_fk IS NOT NULL""",
    "ongoing_course_progress": f"""
        SELECT DISTINCT course_name, course_order_id, module_order_id, module_name, first_name,
               is_badge_earned_module, r.programme_id_fk
        FROM FactModulePerformanceSnapshot f
        JOIN DimUser USING (user_id)
        JOIN DimModule USING (module_id)
        JOIN DimModuleOffering s
          ON s.module_id = f.module_id AND s.cohort_schedule_id = f.cohort_identifier_fk
        JOIN DimCourseOffering r ON r.cohort_schedule_id = f.cohort_identifier_fk
        JOIN DimCourse USING (course_id)
        WHERE {NOW} >= r.course_offering_start_timestamp
          AND {NOW} < r.course_offering_end_timestamp""",
    "inactive_users": """
        SELECT programme_id, first_name AS inactive_user_name
        FROM DimUser JOIN FactProgrammePerformanceSnapshot USING (user_id)
        WHERE NOT is_alive AND first_name IS NOT NULL GROUP BY ALL""",
    "blocked_users": """
        SELECT programme_id, first_name AS blocked_user_name
        FROM DimUser JOIN fact_user_programme_enrolment USING (user_id)
        WHERE is_access_blocked_enrolment AND first_name IS NOT NULL GROUP BY ALL""",
    "lagging_users": f"""
        SELECT programme_id_fk, first_name,
               COUNT(DISTINCT run || '-' || course_name) AS course_records_count
        FROM (SELECT f.programme_id_fk, u.first_name, c.course_name,
                     f.cohort_identifier_fk AS run
              FROM FactCoursePerformanceSnapshot f
              JOIN DimUser u USING (user_id)
              JOIN DimCourseOffering r ON r.cohort_schedule_id = f.cohort_identifier_fk
              JOIN DimCourse c ON c.course_id = r.course_id
              WHERE NOT f.is_certificate_earned_course
                AND {NOW} > r.course_offering_end_timestamp) late
        GROUP BY ALL""",
    "completed_courses": """
        SELECT programme_id_fk AS programme_id, course_id, course_name
        FROM DimCourse JOIN DimCourseOffering USING (course_id)""",
    "program_metrics": f"""
        SELECT programme_id, {_r('AVG(progress_percentage)')} AS avg_progress,
               {_r('AVG(engagement_score_percentage)')} AS avg_engagement
        FROM FactProgrammePerformanceSnapshot GROUP BY programme_id""",
    "learner_pacing": """
        SELECT programme_id, COUNT(DISTINCT user_id) AS total_learners,
               COUNT(DISTINCT user_id) AS active_learners,
               COUNT(DISTINCT user_id) FILTER (learner_category = 'Ahead') AS ahead_count,
               COUNT(DISTINCT user_id) FILTER (learner_category = 'On Track') AS on_track_count,
               COUNT(DISTINCT user_id) FILTER (learner_category = 'Behind') AS behind_count
        FROM FactProgrammePerformanceSnapshot GROUP BY programme_id""",
    "user_cert_status": """
        SELECT r.course_order_id, c.course_name, u.first_name, f.is_certificate_earned_course,
               f.programme_id_fk
        FROM DimCourseOffering r
        JOIN FactCoursePerformanceSnapshot f
          ON f.course_id = r.course_id AND f.programme_id_fk = r.programme_id_fk
        JOIN DimUser u ON u.user_id = f.user_id
        JOIN DimCourse c ON c.course_id = f.course_id
        WHERE EXISTS (SELECT 1 FROM DimProgramme p WHERE p.programme_id = f.programme_id_fk)""",
}

# --- programme report ---------------------------------------------------------------------------

VALID = """
    SELECT programme_id AS id, programme_name AS name, pm_email, pm_name AS program_manager,
           offering_status AS status, updated_on_timestamp AS last_updated, available_platform,
           defined_total_courses AS total_course_certificates, offering_start_timestamp,
           offering_end_timestamp, category, cohort_identifier AS cohort,
           program_total_points_defined AS total_points, certificate_pass_percentage,
           programme_badge_percentage AS badge_percentage, distinction_percentage,
           programme_allowed_quiz_attempts AS allowed_quiz_attempts,
           programme_badge_bonus_points AS badge_bonus_points, TRUE AS is_valid
    FROM DimProgrammeOffering JOIN DimProgramme USING (programme_id)
    WHERE is_valid_offering = 1"""

EXTRA = {
    "valid_offering": VALID,
    **{f"b_{k}": v for k, v in BLOCKS.items()},
}


def _count_of(block: str, key: str) -> str:
    return f"(SELECT COUNT(*) FROM b_{block} b WHERE b.{key} = o.id)"


PROGRAMS = f"""
    SELECT id, name, pm_email, program_manager, status, {_ts('last_updated')} AS last_updated,
           available_platform, total_course_certificates,
           {_ts('offering_start_timestamp')} AS offering_start_timestamp,
           {_ts('offering_end_timestamp')} AS offering_end_timestamp, category, cohort,
           total_points, certificate_pass_percentage, badge_percentage, distinction_percentage,
           allowed_quiz_attempts, badge_bonus_points, is_valid,
           GREATEST(1, (SELECT COUNT(*) FROM DimCourseOffering r
                        WHERE r.programme_id_fk = o.id AND r.cohort_identifier_fk = o.cohort))
             AS course_count,
           COALESCE(l.total_learners, 0) AS learners_total,
           COALESCE(l.active_learners, 0) AS learners_active,
           COALESCE(l.ahead_count, 0) AS pacing_ahead,
           COALESCE(l.on_track_count, 0) AS pacing_on_track,
           COALESCE(l.behind_count, 0) AS pacing_behind,
           {_count_of('inactive_users', 'programme_id')} AS is_alive,
           {_count_of('blocked_users', 'programme_id')} AS access_blocked,
           {_count_of('lagging_users', 'programme_id_fk')} AS laggards_count,
           {_count_of('completed_courses', 'programme_id')} AS completed_course_count,
           {_count_of('ongoing_course_progress', 'programme_id_fk')} AS ongoing_count,
           {_count_of('user_cert_status', 'programme_id_fk')} AS cert_status_count,
           COALESCE(m.avg_progress, 0) AS progress, COALESCE(m.avg_engagement, 0) AS engagement
    FROM valid_offering o
    LEFT JOIN b_learner_pacing l ON l.programme_id = o.id
    LEFT JOIN b_program_metrics m ON m.programme_id = o.id"""

_O = ("offering_start_timestamp", "offering_end_timestamp")
DURATION = f"""
    SELECT id, cohort, {_date(_O[0])} AS start, {_date(_O[1])} AS "end",
           {_elapsed(*_O)} AS time_elapsed, {_remaining(*_O)} AS remaining_time
    FROM valid_offering"""

PROGRAM_PRESENTATION = f"""
    SELECT o.id, o.cohort, {_date('o.last_updated')} AS last_updated,
           {_elapsed(*('o.' + c for c in _O))} AS time_elapsed,
           {_remaining(*('o.' + c for c in _O))} AS remaining_time,
           r.course_id AS c_course_id, c.course_name AS c_course_name,
           {_date('r.course_offering_start_timestamp')} AS c_start_date,
           {_date('r.course_offering_end_timestamp')} AS c_end_date,
           r.course_total_points_defined AS c_course_total_points,
           r.course_issue_badges_flag AS c_issue_badges,
           r.course_badge_percentage AS c_badge_percentage,
           r.course_allowed_quiz_attempts AS c_allowed_quiz_attempts,
           r.course_badge_bonus_points AS c_badge_bonus_points,
           r.course_sla_ita_attendance_points AS c_sla_ita_attendance_points,
           r.cohort_schedule_id AS c_cohort_schedule_id,
           CASE WHEN r.course_id IS NOT NULL THEN COALESCE(r.certificate_pass_percentage, 0) END
             AS c_certificate_pass_percentage,
           s.module_id AS m_module_id, d.module_name AS m_module_name,
           s.cohort_schedule_id AS m_cohort_schedule_id,
           {_date('s.module_offering_start_timestamp')} AS m_start_date,
           {_date('s.module_offering_end_timestamp')} AS m_end_date,
           s.module_total_points_defined AS m_module_total_points,
           s.module_issue_badges_flag AS m_issue_badges,
           s.module_badge_percentage AS m_badge_percentage,
           s.module_allowed_quiz_attempts AS m_allowed_quiz_attempts,
           s.module_sla_ita_attendance_points AS m_sla_ita_attendance_points,
           s.module_badge_bonus_points AS m_badge_bonus_points
    FROM valid_offering o
    LEFT JOIN DimCourseOffering r
      ON r.programme_id_fk = o.id AND r.cohort_identifier_fk = o.cohort
    LEFT JOIN DimCourse c ON c.course_id = r.course_id
    LEFT JOIN DimModuleOffering s
      ON s.programme_id_fk = r.programme_id_fk AND s.cohort_schedule_id = r.cohort_schedule_id
     AND s.course_id_fk = r.course_id
    LEFT JOIN DimModule d ON d.module_id = s.module_id"""


def _items(field: str, block: str, key: str, **columns: str) -> str:
    types = {
        "user": "VARCHAR",
        "count": "INTEGER",
        "course_id": "VARCHAR",
        "course_name": "VARCHAR",
        "course_order_id": "INTEGER",
        "module_order_id": "INTEGER",
        "module_name": "VARCHAR",
        "first_name": "VARCHAR",
        "earned": "BOOLEAN",
    }
    picked = ", ".join(f'CAST({columns.get(n, "NULL")} AS {t}) AS "{n}"' for n, t in types.items())
    return (
        f"SELECT o.id, o.cohort, '{field}' AS field, {picked} "
        f"FROM valid_offering o JOIN b_{block} b ON b.{key} = o.id"
    )


PROGRAM_LISTS = " UNION ALL ".join(
    [
        _items("is_alive_list", "inactive_users", "programme_id", first_name="inactive_user_name"),
        _items(
            "access_blocked_list", "blocked_users", "programme_id", first_name="blocked_user_name"
        ),
        _items(
            "lagging_courses_list",
            "lagging_users",
            "programme_id_fk",
            user="first_name",
            count="course_records_count",
        ),
        _items(
            "completed_courses_list",
            "completed_courses",
            "programme_id",
            course_id="course_id",
            course_name="course_name",
        ),
        _items(
            "ongoing_course_progress",
            "ongoing_course_progress",
            "programme_id_fk",
            course_name="course_name",
            course_order_id="course_order_id",
            module_order_id="module_order_id",
            module_name="module_name",
            first_name="first_name",
            earned="is_badge_earned_module",
        ),
        _items(
            "programme_user_cert_status_list",
            "user_cert_status",
            "programme_id_fk",
            course_order_id="course_order_id",
            course_name="course_name",
            first_name="first_name",
            earned="is_certificate_earned_course",
        ),
    ]
)

# --- learner blocks and report ------------------------------------------------------------------

INFO = """
    SELECT programme_id, programme_name, offering_status, defined_total_course_certificates,
           CAST((SELECT COALESCE(SUM(r.total_badges), 0) FROM DimCourseOffering r
                 WHERE r.programme_id_fk = programme_id) AS BIGINT) AS total_badges
    FROM DimProgramme LEFT JOIN DimProgrammeOffering USING (programme_id)"""

PERFORMANCE = f"""
    SELECT programme_id, COUNT(*) FILTER (completion_status) AS completion_certificates,
           COUNT(*) FILTER (distinction_status) AS distinction_certificates,
           {_r('SUM(COALESCE(performance_score_percentage, 0)) / COUNT(*)')} AS performance
    FROM FactProgrammePerformanceSnapshot GROUP BY programme_id"""

LEARNER_MODULES = f"""
    SELECT s.programme_id_fk AS programme_id, s.cohort_schedule_id, f.user_id, f.course_id_fk,
           s.module_id, module_name,
           s.module_offering_start_timestamp, s.module_offering_end_timestamp,
           {MODULE_SETTINGS},
           {_r('COALESCE(f.engagement_score_module_percentage, 0)')} AS engagement,
           {_r('COALESCE(f.progress_percentage_module, 0)')} AS progress,
           {_r('COALESCE(f.performance_score_module_percentage, 0)')} AS performance,
           COALESCE(f.is_badge_earned_module, FALSE) AS badge,
           COALESCE(f.earned_bonus_points_module, 0) AS bonus_points,
           COALESCE(f.time_spent_seconds_module, 0) AS time_spent_seconds_module,
           COALESCE(f.achieved_points_module, 0) AS achieved_points
    FROM DimModuleOffering s JOIN DimModule d ON d.module_id = s.module_id
    JOIN FactModulePerformanceSnapshot f
      ON f.module_id = s.module_id AND f.cohort_identifier_fk = s.cohort_schedule_id
     AND f.programme_id_fk = s.programme_id_fk"""

LEARNER_COURSES = f"""
    SELECT r.programme_id_fk AS programme_id, f.user_id, r.course_id, course_name,
           r.course_offering_start_timestamp, r.course_offering_end_timestamp,
           {COURSE_SETTINGS}, r.cohort_schedule_id, r.certificate_pass_percentage, r.total_badges,
           {_r('COALESCE(f.progress_percentage_course, 0)')} AS progress,
           {_r('COALESCE(f.engagement_score_course_percentage, 0)')} AS engagement,
           {_r('COALESCE(f.performance_score_course_percentage, 0)')} AS performance,
           COALESCE(f.is_certificate_earned_course, FALSE) AS certificate_earned,
           COALESCE(f.time_spent_seconds_course, 0) AS time_spent_seconds_course,
           COALESCE(f.achieved_points_course, 0) AS achieved_points
    FROM DimCourseOffering r JOIN DimCourse c ON c.course_id = r.course_id
    JOIN FactCoursePerformanceSnapshot f
      ON f.cohort_identifier_fk = r.cohort_schedule_id AND f.course_id = r.course_id
     AND f.programme_id_fk = r.programme_id_fk"""

LEARNERS = f"""
    SELECT f.programme_id, user_id, first_name AS name, email, learner_category AS status,
           {_r('COALESCE(progress_percentage, 0)')} AS progress,
           {_r('COALESCE(engagement_score_percentage, 0)')} AS engagement,
           {_r('COALESCE(performance_score_percentage, 0)')} AS performance,
           COALESCE(time_spent_seconds, 0) AS time_spent_seconds,
           COALESCE(achieved_points, 0) AS achieved_points,
           COALESCE(badges_earned_count, 0) AS badges,
           COALESCE(total_unlocked_course_points_in_programme, 0) AS total_points,
           IF(completion_status, 1, 0) AS completion_certificate,
           IF(distinction_status, 1, 0) AS distinction_certificate,
           (SELECT COUNT(*) FROM FactCoursePerformanceSnapshot k
            WHERE k.user_id = f.user_id AND k.programme_id_fk = f.programme_id
              AND k.is_certificate_earned_course) AS course_certificates_earned,
           last_active
    FROM FactProgrammePerformanceSnapshot f JOIN DimUser USING (user_id)"""

EXTRA |= {
    "b_info": INFO,
    "b_performance": PERFORMANCE,
    "b_learner_modules": LEARNER_MODULES,
    "b_learner_courses": LEARNER_COURSES,
    "b_learners": LEARNERS,
}

HEADER = """
    SELECT i.programme_id AS id, programme_name AS name, offering_status AS status,
           COALESCE(completion_certificates, 0) AS completion_certificates,
           COALESCE(distinction_certificates, 0) AS distinction_certificates,
           COALESCE(performance, 0) AS performance,
           COALESCE(defined_total_course_certificates, 0) AS total_course_certificates,
           total_badges
    FROM b_info i LEFT JOIN b_performance p ON p.programme_id = i.programme_id"""
EXTRA["b_header"] = HEADER

LEARNER_PRESENTATION = f"""
    SELECT h.id, h.status,
           l.user_id AS l_id, l.name AS l_name, l.email AS l_email, l.status AS l_status,
           l.progress AS l_progress, l.engagement AS l_engagement,
           l.performance AS l_performance, {_time('l.time_spent_seconds')} AS l_time_spent,
           l.achieved_points AS l_achieved_points, l.badges AS l_badges,
           l.total_points AS l_total_points,
           CAST(l.course_certificates_earned AS INTEGER) AS l_course_certificates_earned,
           {_date('l.last_active')} AS l_last_active,
           l.completion_certificate AS l_completion, l.distinction_certificate AS l_distinction,
           c.course_id AS c_id, c.course_name AS c_name, c.progress AS c_progress,
           c.engagement AS c_engagement, c.performance AS c_performance,
           c.certificate_earned AS c_certificate_earned,
           CASE WHEN c.course_id IS NOT NULL THEN {_time('c.time_spent_seconds_course')} END
             AS c_time_spent,
           c.achieved_points AS c_achieved_points,
           c.course_total_points_defined AS c_total_points, c.total_badges AS c_total_badges,
           c.certificate_pass_percentage AS c_certificate_pass_percentage,
           {_date('c.course_offering_start_timestamp')} AS c_start_date,
           m.module_id AS m_id, m.module_name AS m_name, m.engagement AS m_engagement,
           m.progress AS m_progress, m.performance AS m_performance, m.badge AS m_badge,
           m.bonus_points AS m_bonus_points,
           CASE WHEN m.module_id IS NOT NULL THEN {_time('m.time_spent_seconds_module')} END
             AS m_time_spent,
           m.achieved_points AS m_achieved_points,
           m.module_total_points_defined AS m_total_points,
           {_date('m.module_offering_start_timestamp')} AS m_start_date
    FROM b_header h JOIN b_learners l ON l.programme_id = h.id
    LEFT JOIN b_learner_courses c ON c.programme_id = l.programme_id AND c.user_id = l.user_id
    LEFT JOIN b_learner_modules m
      ON m.programme_id = c.programme_id AND m.user_id = c.user_id
     AND m.course_id_fk = c.course_id"""

# Offerings that agree in every header field cannot be told apart; one of them is kept.
FIRST_HEADER = """
    SELECT * FROM b_header
    QUALIFY 1 = ROW_NUMBER() OVER (
      PARTITION BY id ORDER BY status NULLS FIRST, name NULLS FIRST, completion_certificates,
      distinction_certificates, performance, total_course_certificates, total_badges)"""
EXTRA["b_first_header"] = FIRST_HEADER

_WHOLE_LEARNER = "user_id IS NOT NULL AND name IS NOT NULL AND email IS NOT NULL AND status IS NOT NULL"

#: The programme that the single-programme query asks for.
ONE_PROGRAMME = "P7"

_KEPT = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("h.id", "h.name", "h.status"))
EXTRA["b_kept_learners"] = f"SELECT * FROM b_learners WHERE {_WHOLE_LEARNER}"


def _documents(header: str, where: str) -> str:
    """The presented rows of ``header``, with one row of nulls for a programme without learners."""
    sql = LEARNER_PRESENTATION.replace(
        "FROM b_header h JOIN b_learners l", f"FROM {header} h LEFT JOIN b_kept_learners l"
    )
    shown = f"{_time('l.time_spent_seconds')} AS l_time_spent"
    return sql.replace(shown, f"CASE WHEN l.user_id IS NOT NULL THEN {_time('l.time_spent_seconds')} END AS l_time_spent") + where


LEARNER_DOCUMENTS = _documents("b_header", f" {_KEPT}")
LEARNER_ONE = _documents("b_first_header", f" {_KEPT} AND h.id = '{ONE_PROGRAMME}'")

QUARANTINED = f"""
    SELECT programme_id, user_id AS id, name, email, status, progress, engagement, performance,
           {_time('time_spent_seconds')} AS time_spent, achieved_points, badges, total_points,
           course_certificates_earned, {_date('last_active')} AS last_active,
           completion_certificate AS completion, distinction_certificate AS distinction
    FROM b_learners WHERE NOT ({_WHOLE_LEARNER})"""

WHOLE_DOCUMENTS = f"""
    SELECT p.id, p.name, p.pm_email, p.program_manager, p.status,
           {_date('o.last_updated')} AS last_updated, p.available_platform,
           CAST(p.total_course_certificates AS BIGINT) AS total_course_certificates,
           d.start, d."end", d.time_elapsed, d.remaining_time, p.category, p.cohort,
           CAST(p.total_points AS BIGINT) AS total_points, p.certificate_pass_percentage,
           p.badge_percentage, p.distinction_percentage,
           CAST(p.allowed_quiz_attempts AS BIGINT) AS allowed_quiz_attempts,
           CAST(p.badge_bonus_points AS BIGINT) AS badge_bonus_points, p.is_valid,
           p.course_count AS courses, p.learners_total, p.learners_active, p.pacing_ahead,
           p.pacing_on_track, p.pacing_behind, p.is_alive, p.is_alive AS is_alive_list,
           p.access_blocked, p.access_blocked AS access_blocked_list, p.laggards_count,
           p.laggards_count AS lagging_courses_list, p.completed_course_count,
           p.completed_course_count AS completed_courses_list, p.progress, p.engagement,
           p.ongoing_count AS ongoing_course_progress,
           p.cert_status_count AS programme_user_cert_status_list
    FROM ({PROGRAMS}) p JOIN ({DURATION}) d ON d.id = p.id AND d.cohort = p.cohort
    JOIN valid_offering o ON o.id = p.id AND o.cohort = p.cohort"""

TYPED_LEARNER = f"""
    SELECT programme_id, user_id AS id, name, email, status, progress, engagement, performance,
           {_time('time_spent_seconds')} AS time_spent, achieved_points, badges, total_points,
           CAST(course_certificates_earned AS INTEGER) AS course_certificates_earned,
           {_date('last_active')} AS last_active,
           completion_certificate AS completion, distinction_certificate AS distinction
    FROM b_learners
    WHERE user_id IS NOT NULL AND name IS NOT NULL AND email IS NOT NULL AND status IS NOT NULL"""


def _nulls(level: str, source: str, programme: str, user: str, fields: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, {programme} AS programme_id, CAST({user} AS VARCHAR) AS user_id, "
        f"CAST(NULL AS VARCHAR) AS item_id, '{f}' AS field, 'null' AS reason "
        f"FROM {source} WHERE {f} IS NULL"
        for f in fields.split()
    )


def _beyond(level: str, block: str, item: str, *fields: str, programme: str = "programme_id_fk") -> str:
    """Integers inside a list that leave 32 bits."""
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{level}' AS level, CAST({programme} AS VARCHAR) AS programme_id, "
        f"CAST(first_name AS VARCHAR) AS user_id, CAST({item} AS VARCHAR) AS item_id, '{name}' AS field, "
        f"'integer out of range' AS reason FROM b_{block} "
        f"WHERE {column} NOT BETWEEN -2147483648 AND 2147483647"
        for name, _, column in (f.partition("=") for f in fields)
    )


VIOLATIONS = (
    _nulls("programme", "b_header", "id", "NULL", "id name status")
    + " UNION ALL "
    + _nulls("learner", "(SELECT user_id AS id, * FROM b_learners)", "programme_id", "id",
             "id name email status")
    + " UNION ALL "
    + _beyond("lagging_course", "lagging_users", "NULL", "count=course_records_count")
    + " UNION ALL "
    + _beyond("ongoing_module", "ongoing_course_progress", "module_name",
              "course_order_id=course_order_id", "module_order_id=module_order_id")
    + " UNION ALL "
    + _beyond("course_certificate", "user_cert_status", "course_name", "course_order_id=course_order_id")
)


def _text(sql: str, *timestamps: str) -> str:
    replaced = ", ".join(f"{_ts(c)} AS {c}" for c in timestamps)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql})"


_M = ("module_offering_start_timestamp", "module_offering_end_timestamp")
_C = ("course_offering_start_timestamp", "course_offering_end_timestamp")

_STATEMENTS = {
    **BLOCKS,
    "programs": PROGRAMS,
    "program_duration": DURATION,
    "program_presentation": PROGRAM_PRESENTATION,
    "program_documents": PROGRAM_PRESENTATION,
    "program_lists": PROGRAM_LISTS,
    "programme_info": INFO,
    "programme_performance": PERFORMANCE,
    "learner_modules": _text(LEARNER_MODULES, *_M),
    "learner_courses": _text(
        f"""SELECT *, (SELECT COUNT(*) FROM b_learner_modules m
                       WHERE m.programme_id = c.programme_id AND m.user_id = c.user_id
                         AND m.course_id_fk = c.course_id) AS module_count
            FROM ({LEARNER_COURSES}) c""",
        *_C,
    ),
    "learner_data": _text(
        f"""SELECT *, (SELECT COUNT(*) FROM b_learner_courses c
                       WHERE c.programme_id = l.programme_id AND c.user_id = l.user_id)
                      AS course_count
            FROM ({LEARNERS}) l""",
        "last_active",
    ),
    "learner_progress": """
        SELECT *, (SELECT COUNT(*) FROM b_learners l WHERE l.programme_id = h.id) AS learner_count
        FROM b_header h""",
    "learner_presentation": LEARNER_PRESENTATION,
    "learner_documents": LEARNER_DOCUMENTS,
    "learner_progress_one": LEARNER_ONE,
    "quarantined_programmes": """
        SELECT * FROM b_header WHERE id IS NULL OR name IS NULL OR status IS NULL""",
    "quarantined_learners": QUARANTINED,
    "program_documents_whole": WHOLE_DOCUMENTS,
    "learner_progress_first": """
        SELECT h.id, h.name, h.status,
               CAST(h.completion_certificates AS INTEGER) AS completion_certificates,
               CAST(h.distinction_certificates AS INTEGER) AS distinction_certificates,
               h.performance, h.total_course_certificates,
               CAST(h.total_badges AS INTEGER) AS total_badges, l.user_id AS learner_id,
               l.name AS learner_name,
               (SELECT COUNT(*) FROM b_learner_courses c
                WHERE c.programme_id = h.id AND c.user_id = l.user_id) AS course_count
        FROM b_first_header h LEFT JOIN b_kept_learners l ON l.programme_id = h.id
        """ + _KEPT,
    "contract_conform": TYPED_LEARNER,
    "contract_violations": VIOLATIONS,
    "field_selection": f"""
        SELECT o.id, o.cohort, {_remaining(*('o.' + c for c in _O))} AS remaining_time,
               r.course_id, s.module_id
        FROM valid_offering o
        LEFT JOIN DimCourseOffering r
          ON r.programme_id_fk = o.id AND r.cohort_identifier_fk = o.cohort
        LEFT JOIN DimModuleOffering s
          ON s.programme_id_fk = r.programme_id_fk AND s.cohort_schedule_id = r.cohort_schedule_id
         AND s.course_id_fk = r.course_id""",
    "programs_snapshot": PROGRAMS,
    "program_documents_snapshot": PROGRAM_PRESENTATION,
    "program_documents_stored": PROGRAM_LISTS,
    "time_spent_text": f"""
        SELECT user_id, cohort_identifier_fk, time_spent_seconds_course AS seconds,
               {_time('time_spent_seconds_course')} AS time_spent
        FROM FactCoursePerformanceSnapshot""",
    "date_text": f"""
        SELECT programme_id, user_id, {_ts('last_active')} AS last_active,
               {_date('last_active')} AS last_active_date
        FROM FactProgrammePerformanceSnapshot""",
    "duration_text": f"""
        SELECT cohort_schedule_id, module_id, {_date(_M[0])} AS start, {_date(_M[1])} AS "end",
               {_elapsed(*_M)} AS time_elapsed, {_remaining(*_M)} AS remaining_time
        FROM DimModuleOffering""",
}

# The eleven sources, timestamps as text.
_TIMESTAMPS = {
    "DimProgrammeOffering": ("updated_on_timestamp", *_O),
    "DimCourseOffering": _C,
    "DimModuleOffering": _M,
    "FactProgrammePerformanceSnapshot": ("last_active",),
}


def _source(table: str) -> str:
    stamps = _TIMESTAMPS.get(table)
    return _text(f"SELECT * FROM {table}", *stamps) if stamps else f"SELECT * FROM {table}"


def statements() -> dict[str, str]:
    from cohortlens.schemas import INPUTS

    found = {key: _with_inputs(sql, **EXTRA) for key, sql in _STATEMENTS.items()}
    found |= {f"source_{key}": _with_inputs(_source(name)) for key, (name, _) in INPUTS.items()}
    return found
