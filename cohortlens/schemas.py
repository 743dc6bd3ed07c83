"""Input columns of the eleven tables and the two output contracts."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, BOOLEAN = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

# Attribute of ``Tables`` -> (table name, {column: type}).  "int" columns may be stored as 32- or
# 64-bit integers, "flag" as an integer or a boolean.
# The table and column names are the data model's.
INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    "programmes": ("DimProgramme", {"programme_id": "string", "programme_name": "string"}),
    "programme_offerings": (
        "DimProgrammeOffering",
        {
            "programme_id": "string",
            "cohort_identifier": "string",
            "is_valid_offering": "flag",
            "pm_name": "string",
            "pm_email": "string",
            "offering_status": "string",
            "updated_on_timestamp": "timestamp",
            "available_platform": "string",
            "defined_total_courses": "int",
            "defined_total_course_certificates": "int",
            "offering_start_timestamp": "timestamp",
            "offering_end_timestamp": "timestamp",
            "category": "string",
            "program_total_points_defined": "int",
            "certificate_pass_percentage": "double",
            "programme_badge_percentage": "double",
            "distinction_percentage": "double",
            "programme_allowed_quiz_attempts": "int",
            "programme_badge_bonus_points": "int",
        },
    ),
    "courses": ("DimCourse", {"course_id": "string", "course_name": "string"}),
    "course_offerings": (
        "DimCourseOffering",
        {
            "cohort_schedule_id": "string",
            "programme_id_fk": "string",
            "cohort_identifier_fk": "string",
            "course_id": "string",
            "course_order_id": "int",
            "course_offering_start_timestamp": "timestamp",
            "course_offering_end_timestamp": "timestamp",
            "course_total_points_defined": "int",
            "course_issue_badges_flag": "boolean",
            "course_badge_percentage": "double",
            "course_allowed_quiz_attempts": "int",
            "course_badge_bonus_points": "int",
            "course_sla_ita_attendance_points": "int",
            "certificate_pass_percentage": "double",
            "total_badges": "int",
        },
    ),
    "modules": ("DimModule", {"module_id": "string", "module_name": "string"}),
    "module_offerings": (
        "DimModuleOffering",
        {
            "programme_id_fk": "string",
            "cohort_schedule_id": "string",
            "course_id_fk": "string",
            "module_id": "string",
            "module_order_id": "int",
            "module_offering_start_timestamp": "timestamp",
            "module_offering_end_timestamp": "timestamp",
            "module_total_points_defined": "int",
            "module_issue_badges_flag": "boolean",
            "module_badge_percentage": "double",
            "module_allowed_quiz_attempts": "int",
            "module_sla_ita_attendance_points": "int",
            "module_badge_bonus_points": "int",
        },
    ),
    "users": ("DimUser", {"user_id": "string", "first_name": "string", "email": "string"}),
    "programme_facts": (
        "FactProgrammePerformanceSnapshot",
        {
            "user_id": "string",
            "programme_id": "string",
            "is_alive": "boolean",
            "learner_category": "string",
            "progress_percentage": "double",
            "engagement_score_percentage": "double",
            "performance_score_percentage": "double",
            "completion_status": "boolean",
            "distinction_status": "boolean",
            "time_spent_seconds": "int",
            "achieved_points": "int",
            "badges_earned_count": "int",
            "total_unlocked_course_points_in_programme": "int",
            "last_active": "timestamp",
        },
    ),
    "course_facts": (
        "FactCoursePerformanceSnapshot",
        {
            "user_id": "string",
            "programme_id_fk": "string",
            "cohort_identifier_fk": "string",
            "course_id": "string",
            "is_certificate_earned_course": "boolean",
            "progress_percentage_course": "double",
            "engagement_score_course_percentage": "double",
            "performance_score_course_percentage": "double",
            "time_spent_seconds_course": "int",
            "achieved_points_course": "int",
        },
    ),
    "module_facts": (
        "FactModulePerformanceSnapshot",
        {
            "user_id": "string",
            "programme_id_fk": "string",
            "cohort_identifier_fk": "string",
            "course_id_fk": "string",
            "module_id": "string",
            "is_badge_earned_module": "boolean",
            "progress_percentage_module": "double",
            "engagement_score_module_percentage": "double",
            "performance_score_module_percentage": "double",
            "earned_bonus_points_module": "int",
            "time_spent_seconds_module": "int",
            "achieved_points_module": "int",
        },
    ),
    "enrolments": (
        "fact_user_programme_enrolment",
        {"user_id": "string", "programme_id": "string", "is_access_blocked_enrolment": "boolean"},
    ),
}


def _struct(required: bool = False, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, not required) for n, t in fields.items()])


def _list_of(element: T.DataType, element_null: bool = False) -> T.ArrayType:
    return T.ArrayType(element, element_null)


# The output contracts.  Fixed values: field names, order and types are part of the interface.
DURATION = _struct(start=STRING, end=STRING, time_elapsed=DOUBLE, remaining_time=STRING)

PROGRAM_MODULE = _struct(
    module_id=STRING,
    module_name=STRING,
    cohort_schedule_id=STRING,
    start_date=STRING,
    end_date=STRING,
    module_total_points=INT,
    issue_badges=BOOLEAN,
    badge_percentage=DOUBLE,
    allowed_quiz_attempts=INT,
    sla_ita_attendance_points=INT,
    badge_bonus_points=INT,
)

PROGRAM_COURSE = _struct(
    course_id=STRING,
    course_name=STRING,
    start_date=STRING,
    end_date=STRING,
    course_total_points=INT,
    issue_badges=BOOLEAN,
    badge_percentage=DOUBLE,
    allowed_quiz_attempts=INT,
    badge_bonus_points=INT,
    sla_ita_attendance_points=INT,
    cohort_schedule_id=STRING,
    certificate_pass_percentage=DOUBLE,
    modules=_list_of(PROGRAM_MODULE),
)

LEARNERS = _struct(
    total=INT,
    active=INT,
    pacing=_struct(ahead=INT, on_track=INT, behind=INT),
)

ONGOING = _struct(
    course_name=STRING,
    course_order_id=INT,
    module_order_id=INT,
    module_name=STRING,
    first_name=STRING,
    is_badge_earned_module=BOOLEAN,
)

CERT_STATUS = _struct(
    course_order_id=INT,
    course_name=STRING,
    first_name=STRING,
    is_certificate_earned_course=BOOLEAN,
)

PROGRAM = _struct(
    id=STRING,
    name=STRING,
    pm_email=STRING,
    program_manager=STRING,
    status=STRING,
    last_updated=STRING,
    available_platform=STRING,
    total_course_certificates=INT,
    duration=DURATION,
    category=STRING,
    cohort=STRING,
    total_points=INT,
    certificate_pass_percentage=DOUBLE,
    badge_percentage=DOUBLE,
    distinction_percentage=DOUBLE,
    allowed_quiz_attempts=INT,
    badge_bonus_points=INT,
    is_valid=BOOLEAN,
    courses=_list_of(PROGRAM_COURSE),
    learners=LEARNERS,
    is_alive=INT,
    is_alive_list=_list_of(STRING, True),
    access_blocked=INT,
    access_blocked_list=_list_of(STRING, True),
    laggards_count=INT,
    lagging_courses_list=_list_of(_struct(user=STRING, count=INT), True),
    completed_course_count=INT,
    completed_courses_list=_list_of(_struct(course_id=STRING, course_name=STRING), True),
    progress=DOUBLE,
    engagement=DOUBLE,
    ongoing_course_progress=_list_of(ONGOING),
    programme_user_cert_status_list=_list_of(CERT_STATUS),
)

LEARNER_MODULE = _struct(
    id=STRING,
    name=STRING,
    engagement=DOUBLE,
    progress=DOUBLE,
    performance=DOUBLE,
    badge=BOOLEAN,
    bonus_points=INT,
    time_spent=STRING,
    achieved_points=INT,
    total_points=INT,
    start_date=STRING,
)

LEARNER_COURSE = _struct(
    id=STRING,
    name=STRING,
    progress=DOUBLE,
    engagement=DOUBLE,
    performance=DOUBLE,
    certificate_earned=BOOLEAN,
    time_spent=STRING,
    achieved_points=INT,
    total_points=INT,
    total_badges=INT,
    certificate_pass_percentage=DOUBLE,
    start_date=STRING,
    modules=_list_of(LEARNER_MODULE),
)

CERTIFICATES = _struct(required=True, completion=INT, distinction=INT)

LEARNER = T.StructType(
    [
        T.StructField("id", STRING, False),
        T.StructField("name", STRING, False),
        T.StructField("email", STRING, False),
        T.StructField("status", STRING, False),
        T.StructField("progress", DOUBLE, False),
        T.StructField("engagement", DOUBLE, False),
        T.StructField("performance", DOUBLE, False),
        T.StructField("time_spent", STRING, False),
        T.StructField("achieved_points", INT, False),
        T.StructField("badges", INT, False),
        T.StructField("total_points", INT, False),
        T.StructField("certificates", CERTIFICATES, False),
        T.StructField("courses", _list_of(LEARNER_COURSE), False),
        T.StructField("course_certificates_earned", INT, False),
        T.StructField("last_active", STRING, True),
    ]
)

LEARNER_PROGRESS = _struct(
    required=True,
    id=STRING,
    name=STRING,
    status=STRING,
    completion_certificates=INT,
    distinction_certificates=INT,
    performance=DOUBLE,
    total_course_certificates=INT,
    total_badges=INT,
    learner_data=_list_of(LEARNER),
)

# Column that carries the programme in each table that has one (used by single-programme mode).
PROGRAMME_COLUMN = {
    "programmes": "programme_id",
    "programme_offerings": "programme_id",
    "course_offerings": "programme_id_fk",
    "module_offerings": "programme_id_fk",
    "programme_facts": "programme_id",
    "course_facts": "programme_id_fk",
    "module_facts": "programme_id_fk",
    "enrolments": "programme_id",
}
