"""The eleven tables derived from the TPC-H-like test tables.

The recipes are SQL text that Spark and DuckDB both accept, so a check on another engine can start
from the same inputs.  ``{name}`` stands for a raw table or for another recipe.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from cohortlens.schemas import INPUTS
from cohortlens.session import configure, shared_folder, size_shuffles
from cohortlens.sinks.writers import write_by_programme, write_report
from cohortlens.sources.tables import Tables

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _view(source: str, **columns: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


RECIPES: dict[str, str] = {
    "course_fact_base": _view(
        "{orders} GROUP BY 1,2",
        u="o_custkey",
        k="CAST(FLOOR(o_orderkey/150) AS BIGINT)",
        h="MIN(o_orderkey)",
    ),
    "module_fact_base": _view(
        "{lineitem} JOIN {orders} ON l_orderkey=o_orderkey GROUP BY 1,2,3",
        u="o_custkey",
        k="CAST(FLOOR(o_orderkey/150) AS BIGINT)",
        m="CAST(FLOOR(o_orderkey/150) AS BIGINT)*20+CAST(l_partkey%20 AS BIGINT)",
        q="CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT)",
        r="MAX(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END)",
    ),
    "DimProgramme": _view(
        "{nation}",
        programme_id="'P'||CAST(n_nationkey AS STRING)",
        programme_name="n_name",
    ),
    "DimProgrammeOffering": _view(
        "(SELECT n_nationkey, n_regionkey, 1 AS c FROM {nation} UNION ALL "
        "SELECT n_nationkey, n_regionkey, 2 AS c FROM {nation}) AS n "
        "JOIN {region} ON n_regionkey=r_regionkey "
        "WHERE n_nationkey<>24 AND (c=1 OR n_nationkey%7=0)",
        programme_id="'P'||CAST(n_nationkey AS STRING)",
        cohort_identifier="'COH'||CAST(n_nationkey AS STRING)||'-'||CAST(c AS STRING)",
        is_valid_offering="CASE WHEN n_nationkey%6=5 THEN 0 ELSE 1 END",
        pm_name="r_name",
        pm_email="LOWER(REPLACE(r_name,' ','.'))||'@example.org'",
        offering_status=(
            "CASE WHEN n_nationkey%3=0 THEN 'Ongoing' WHEN n_nationkey%3=1 THEN 'Completed' "
            "ELSE NULL END"
        ),
        updated_on_timestamp=(
            "TIMESTAMP '1995-01-01 00:00:00' + CAST(n_nationkey*11+1400 AS INT) * INTERVAL "
            "'1' DAY"
        ),
        available_platform="CASE WHEN c=1 THEN 'web' ELSE 'mobile' END",
        defined_total_courses="CAST(n_nationkey%9 AS INT)",
        defined_total_course_certificates=(
            "CASE WHEN n_nationkey%7=0 THEN NULL ELSE CAST(n_nationkey%7 AS INT) END"
        ),
        offering_start_timestamp=(
            "TIMESTAMP '1995-01-01 00:00:00' + CAST(n_nationkey*90 AS INT) * INTERVAL '1' DAY"
        ),
        offering_end_timestamp=(
            "TIMESTAMP '1995-01-01 00:00:00' + CAST(n_nationkey*90+n_nationkey*50 AS INT) * "
            "INTERVAL '1' DAY"
        ),
        category="'cat'||CAST(n_regionkey AS STRING)",
        program_total_points_defined="CAST(n_nationkey*100 AS INT)",
        certificate_pass_percentage="CAST((n_nationkey*37)%401 AS DOUBLE)/4",
        programme_badge_percentage="CAST((n_nationkey*41)%401 AS DOUBLE)/4",
        distinction_percentage="CAST((n_nationkey*43)%401 AS DOUBLE)/4",
        programme_allowed_quiz_attempts="CAST(n_nationkey%4 AS INT)",
        programme_badge_bonus_points="CAST(n_nationkey%6 AS INT)",
    ),
    "DimCourse": _view(
        "{supplier} WHERE s_suppkey%2=0",
        course_id="'C'||CAST(CAST(FLOOR(s_suppkey/2) AS BIGINT) AS STRING)",
        course_name="'Course '||CAST(CAST(FLOOR(s_suppkey/2) AS BIGINT) AS STRING)",
    ),
    "DimCourseOffering": _view(
        "{supplier}",
        cohort_schedule_id="'CS'||CAST(s_suppkey AS STRING)",
        programme_id_fk=(
            "CASE WHEN s_suppkey%10=9 THEN NULL ELSE 'P'||CAST(s_nationkey AS STRING) END"
        ),
        cohort_identifier_fk="'COH'||CAST(s_nationkey AS STRING)||'-1'",
        course_id="'C'||CAST(CAST(FLOOR(s_suppkey/2) AS BIGINT) AS STRING)",
        course_order_id="CAST(s_suppkey%8 AS INT)",
        course_offering_start_timestamp=(
            "TIMESTAMP '1995-01-01 00:00:00' + CAST((s_suppkey*7)%50*40 AS INT) * INTERVAL "
            "'1' DAY"
        ),
        course_offering_end_timestamp=(
            "TIMESTAMP '1995-01-01 00:00:00' + CAST((s_suppkey*7)%50*40+400 AS INT) * "
            "INTERVAL '1' DAY"
        ),
        course_total_points_defined="CAST(s_suppkey%50*10 AS INT)",
        course_issue_badges_flag="(s_suppkey%3=0)",
        course_badge_percentage="CAST((s_suppkey*37)%401 AS DOUBLE)/4",
        course_allowed_quiz_attempts="CAST(s_suppkey%4 AS INT)",
        course_badge_bonus_points="CAST(s_suppkey%6 AS INT)",
        course_sla_ita_attendance_points="CAST(s_suppkey%7 AS INT)",
        certificate_pass_percentage=(
            "CASE WHEN s_suppkey%5=0 THEN NULL ELSE CAST((s_suppkey*41)%401 AS DOUBLE)/4 END"
        ),
        total_badges="CASE WHEN s_suppkey%13=0 THEN NULL ELSE CAST(s_suppkey%5 AS INT) END",
    ),
    "DimModule": _view(
        "{part} WHERE p_partkey%50<>49",
        module_id="'M'||CAST(p_partkey AS STRING)",
        module_name="p_name",
    ),
    "DimModuleOffering": _view(
        "{part} JOIN {DimCourseOffering} co ON "
        "co.cohort_schedule_id='CS'||CAST(CAST(FLOOR(p_partkey/20) AS BIGINT) AS STRING)",
        programme_id_fk="co.programme_id_fk",
        cohort_schedule_id="co.cohort_schedule_id",
        course_id_fk="co.course_id",
        module_id="'M'||CAST(p_partkey AS STRING)",
        module_order_id="CAST(p_partkey%20 AS INT)",
        module_offering_start_timestamp=(
            "co.course_offering_start_timestamp + CAST(p_partkey%20 AS INT) * INTERVAL '1' "
            "DAY"
        ),
        module_offering_end_timestamp="co.course_offering_end_timestamp",
        module_total_points_defined="CAST(p_size AS INT)",
        module_issue_badges_flag="(p_size%2=0)",
        module_badge_percentage="CAST((p_partkey*37)%401 AS DOUBLE)/4",
        module_allowed_quiz_attempts="CAST(p_partkey%4 AS INT)",
        module_sla_ita_attendance_points="CAST(p_partkey%7 AS INT)",
        module_badge_bonus_points="CAST(p_partkey%6 AS INT)",
    ),
    "DimUser": _view(
        "{customer}",
        user_id="'U'||CAST(c_custkey AS STRING)",
        first_name="'Name'||CAST(c_custkey%97 AS STRING)",
        email=(
            "CASE WHEN c_custkey%101=100 THEN NULL ELSE 'u'||CAST(c_custkey AS "
            "STRING)||'@example.org' END"
        ),
    ),
    "FactCoursePerformanceSnapshot": _view(
        "{course_fact_base} JOIN {DimCourseOffering} co ON co.cohort_schedule_id='CS'||CAST(k "
        "AS STRING)",
        user_id="'U'||CAST(u AS STRING)",
        programme_id_fk="co.programme_id_fk",
        cohort_identifier_fk="co.cohort_schedule_id",
        course_id="co.course_id",
        is_certificate_earned_course="CASE WHEN h%17=0 THEN NULL ELSE (h%3=0) END",
        progress_percentage_course=(
            "CASE WHEN h%11=0 THEN NULL ELSE CAST((h*37)%401 AS DOUBLE)/4 END"
        ),
        engagement_score_course_percentage="CAST((h*41)%401 AS DOUBLE)/4",
        performance_score_course_percentage="CAST((h*43)%401 AS DOUBLE)/4",
        time_spent_seconds_course=(
            "CASE WHEN h%19=0 THEN NULL ELSE CAST(h*613%500000 AS BIGINT) END"
        ),
        achieved_points_course="CAST(h%500 AS INT)",
    ),
    "FactModulePerformanceSnapshot": _view(
        "{module_fact_base} JOIN {DimCourseOffering} co ON co.cohort_schedule_id='CS'||CAST(k "
        "AS STRING)",
        user_id="'U'||CAST(u AS STRING)",
        programme_id_fk="co.programme_id_fk",
        cohort_identifier_fk="co.cohort_schedule_id",
        course_id_fk="co.course_id",
        module_id="'M'||CAST(m AS STRING)",
        is_badge_earned_module="CASE WHEN (u+m)%17=0 THEN NULL ELSE (r=1) END",
        progress_percentage_module=(
            "CASE WHEN (u+m)%11=0 THEN NULL ELSE CAST(((u+m)*37)%401 AS DOUBLE)/4 END"
        ),
        engagement_score_module_percentage="CAST(((u+m)*41)%401 AS DOUBLE)/4",
        performance_score_module_percentage="CAST(((u+m)*43)%401 AS DOUBLE)/4",
        earned_bonus_points_module="CAST((u+m)%6 AS INT)",
        time_spent_seconds_module="CAST(q*60 AS BIGINT)",
        achieved_points_module="CAST(q AS INT)",
    ),
    "FactProgrammePerformanceSnapshot": _view(
        "(SELECT DISTINCT user_id, programme_id_fk, CAST(SUBSTR(user_id,2) AS "
        "BIGINT)+CAST(SUBSTR(programme_id_fk,2) AS BIGINT) AS h FROM "
        "{FactCoursePerformanceSnapshot} WHERE programme_id_fk IS NOT NULL) t",
        user_id="user_id",
        programme_id="programme_id_fk",
        is_alive="(h%9<>0)",
        learner_category=(
            "CASE h%4 WHEN 0 THEN 'Ahead' WHEN 1 THEN 'On Track' WHEN 2 THEN 'Behind' END"
        ),
        progress_percentage="CASE WHEN h%11=0 THEN NULL ELSE CAST((h*37)%401 AS DOUBLE)/4 END",
        engagement_score_percentage="CAST((h*41)%401 AS DOUBLE)/4",
        performance_score_percentage=(
            "CASE WHEN h%13=0 THEN NULL ELSE CAST((h*43)%401 AS DOUBLE)/4 END"
        ),
        completion_status="CASE WHEN h%17=0 THEN NULL ELSE (h%3=0) END",
        distinction_status="(h%12=0)",
        time_spent_seconds="CAST(h*977 AS BIGINT)",
        achieved_points="CAST(h%1000 AS INT)",
        badges_earned_count="CAST(h%20 AS INT)",
        total_unlocked_course_points_in_programme=(
            "CASE WHEN h%23=0 THEN NULL ELSE CAST(h%2000 AS INT) END"
        ),
        last_active=(
            "CASE WHEN h%29=0 THEN NULL ELSE TIMESTAMP '1995-01-01 00:00:00' + CAST(h%1400 AS "
            "INT) * INTERVAL '1' DAY END"
        ),
    ),
    "fact_user_programme_enrolment": _view(
        "{customer}",
        user_id="'U'||CAST(c_custkey AS STRING)",
        programme_id="'P'||CAST(c_nationkey AS STRING)",
        is_access_blocked_enrolment="(c_acctbal<0)",
    ),
}


def inputs_of(recipe: str) -> list[str]:
    """Names of the tables a recipe reads."""
    return sorted(set(re.findall(r"\{(\w+)\}", RECIPES[recipe])))


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Changes with the raw files: their paths, lengths and times."""
    found = []
    for name in RAW_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listing = files.listFiles(path, True)
        while listing.hasNext():
            f = listing.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:16]


def stored_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables, each written to the shared folder when it is first needed.

    Reports read a fact more than once and sessions ask for many reports; deriving a fact means
    joining the largest raw tables, so it is done once per application and set of raw files.  The
    written table also spares a lost executor's work from being derived anew.
    """
    views = derived_tables(spark, sf_dir)
    application = spark.sparkContext.applicationId
    root = f"{shared_folder(spark)}/star-{application}-{fingerprint(spark, sf_dir)}"
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(
        spark._jsc.hadoopConfiguration()
    )
    frames: dict[str, DataFrame] = {}

    def resolve(name: str) -> DataFrame:
        if name in RAW_TABLES or name not in {n for n, _ in INPUTS.values()}:
            return views.table(name)
        if name not in frames:
            folder = f"{root}/{name}"
            if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                inputs = {i: resolve(i) for i in inputs_of(name)}
                write_report(spark.sql(RECIPES[name], **inputs), folder, mode="overwrite")
            frames[name] = spark.read.parquet(folder)
        return frames[name]

    return Tables(resolve)


#: The tables that grow with the learners.
FACTS = ("programme_facts", "course_facts", "module_facts")


def tables_by_programme(spark: SparkSession, sf_dir: str) -> Tables:
    """:func:`stored_tables` with the facts stored by programme, for reports on one programme."""
    whole = stored_tables(spark, sf_dir)
    application = spark.sparkContext.applicationId
    root = f"{shared_folder(spark)}/by-programme-{application}-{fingerprint(spark, sf_dir)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = {INPUTS[key][0]: key for key in FACTS}

    def resolve(name: str) -> DataFrame:
        if name not in names:
            return whole.table(name)
        if not files.exists(path(f"{root}/{name}/_SUCCESS")):
            write_by_programme(whole, root, [names[name]], "overwrite")
        return spark.read.parquet(f"{root}/{name}")

    return Tables(resolve)


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables as lazy views over ``<sf_dir>/<raw table>.parquet``."""
    configure(spark)
    size_shuffles(spark, sf_dir)
    frames: dict[str, DataFrame] = {}

    def resolve(name: str) -> DataFrame:
        if name not in frames:
            if name in RAW_TABLES:
                frames[name] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
            else:
                inputs = {i: resolve(i) for i in inputs_of(name)}
                frames[name] = spark.sql(RECIPES[name], **inputs)
        return frames[name]

    return Tables(resolve)
