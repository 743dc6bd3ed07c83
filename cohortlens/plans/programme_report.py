"""Programme report: one row per valid offering, flat or as the full document."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import date_text, schedule, zero_if_null
from cohortlens.operators import programmes as ops
from cohortlens.operators.contract import (
    INT_MAX,
    Level,
    conform_selected,
    field_tree,
    fields_of,
    tree_violations,
    wants,
)
from cohortlens.operators.nesting import (
    PART_SIZE,
    attach_parts,
    collect_parts,
    expand,
    prefixed,
    record,
    split_copies,
)
from cohortlens.schemas import INT, PROGRAM, PROGRAM_COURSE, PROGRAM_MODULE
from cohortlens.sources.tables import Tables

# List of the document -> count of the flat report.
COUNTS = {
    "is_alive_list": "is_alive",
    "access_blocked_list": "access_blocked",
    "lagging_courses_list": "laggards_count",
    "completed_courses_list": "completed_course_count",
    "ongoing_course_progress": "ongoing_count",
    "programme_user_cert_status_list": "cert_status_count",
}

# What identifies a course offering to its modules.
RUN = ["programme_id_fk", "cohort_schedule_id", "course_id"]

# Fields of the document that the flat layouts below read.
PRESENTED = ("id", "cohort", "last_updated", "duration", "courses")
LISTED = ("id", "cohort", *COUNTS)


def valid_offerings(t: Tables) -> DataFrame:
    """Programmes with their valid offerings; equal rows are merged and counted in ``copies``."""
    offerings = t.programme_offerings.filter(F.col("is_valid_offering").cast("bigint") == 1)
    rows = t.programmes.join(offerings, "programme_id").select(
        F.col("programme_id").alias("id"),
        F.col("programme_name").alias("name"),
        "pm_email",
        F.col("pm_name").alias("program_manager"),
        F.col("offering_status").alias("status"),
        F.col("updated_on_timestamp").alias("last_updated"),
        "available_platform",
        F.col("defined_total_courses").alias("total_course_certificates"),
        "offering_start_timestamp",
        "offering_end_timestamp",
        "category",
        F.col("cohort_identifier").alias("cohort"),
        F.col("program_total_points_defined").alias("total_points"),
        "certificate_pass_percentage",
        F.col("programme_badge_percentage").alias("badge_percentage"),
        "distinction_percentage",
        F.col("programme_allowed_quiz_attempts").alias("allowed_quiz_attempts"),
        F.col("programme_badge_bonus_points").alias("badge_bonus_points"),
        F.col("is_valid_offering").cast("boolean").alias("is_valid"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def list_rows(t: Tables, as_of, wanted: Iterable[str] = COUNTS) -> dict[str, DataFrame]:
    """The elements of the programme-level lists, with the number of ``copies`` of each."""
    programme = F.col("programme_id_fk").alias("programme_id")
    once = F.lit(1).cast("bigint").alias("copies")

    def inactive():
        name = F.col("inactive_user_name").alias("first_name")
        return ops.inactive_users(t).select("programme_id", name, once)

    def blocked():
        name = F.col("blocked_user_name").alias("first_name")
        return ops.blocked_users(t).select("programme_id", name, once)

    def lagging():
        count = F.col("course_records_count").alias("count")
        return ops.lagging_users(t, as_of).select(programme, "first_name", count, once)

    def ongoing():
        return ops.ongoing_course_progress(t, as_of).select(
            programme,
            "course_name",
            "course_order_id",
            "module_order_id",
            "module_name",
            "first_name",
            F.col("is_badge_earned_module").alias("earned"),
            once,
        )

    def certificates():
        return ops.user_cert_status_counted(t).select(
            programme,
            "course_order_id",
            "course_name",
            "first_name",
            F.col("is_certificate_earned_course").alias("earned"),
            "copies",
        )

    build = {
        "is_alive_list": inactive,
        "access_blocked_list": blocked,
        "lagging_courses_list": lagging,
        "completed_courses_list": lambda: ops.completed_courses_counted(t),
        "ongoing_course_progress": ongoing,
        "programme_user_cert_status_list": certificates,
    }
    return {field: build[field]() for field in wanted}


def _tagged(rows: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("field", F.lit(field)) for field, df in rows.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _counts(tagged: DataFrame) -> DataFrame:
    # All list lengths from one aggregation that combines before its only shuffle.
    n = F.col("copies")
    return tagged.groupBy(F.col("programme_id").alias("id")).agg(
        *(F.sum(F.when(F.col("field") == f, n)).alias(c) for f, c in COUNTS.items())
    )


def _header(t: Tables, counted: dict[str, DataFrame]) -> DataFrame:
    rollup = ops.programme_rollup(t).withColumnRenamed("programme_id", "id")
    header = valid_offerings(t).join(rollup, "id", "left")
    lengths = {c: F.lit(0).cast("bigint") for c in COUNTS.values()}
    if counted:
        rows = {f: df.select("programme_id", "copies") for f, df in counted.items()}
        header = header.join(_counts(_tagged(rows)), "id", "left")
        lengths = {c: zero_if_null(c) for c in COUNTS.values()}
    return header.withColumns(
        {
            **lengths,
            "learners_total": zero_if_null("total_learners"),
            "learners_active": zero_if_null("active_learners"),
            "pacing_ahead": zero_if_null("ahead_count"),
            "pacing_on_track": zero_if_null("on_track_count"),
            "pacing_behind": zero_if_null("behind_count"),
            "progress": F.coalesce("avg_progress", F.lit(0.0)),
            "engagement": F.coalesce("avg_engagement", F.lit(0.0)),
        }
    )


def programs(t: Tables, as_of) -> DataFrame:
    """Flat report: one row per valid offering, with the length of each list in place of the list."""
    courses = (
        ops.program_courses(t)
        .groupBy(F.col("programme_id_fk").alias("id"), F.col("cohort_identifier_fk").alias("cohort"))
        .agg(F.count("*").alias("course_count"))
    )
    # An offering without courses still lists one empty course.
    listed = F.coalesce("course_count", F.lit(1)) * F.col("copies")
    return (
        _header(t, list_rows(t, as_of))
        .join(courses, ["id", "cohort"], "left")
        .select(
            "id",
            "name",
            "pm_email",
            "program_manager",
            "status",
            "last_updated",
            "available_platform",
            "total_course_certificates",
            "offering_start_timestamp",
            "offering_end_timestamp",
            "category",
            "cohort",
            "total_points",
            "certificate_pass_percentage",
            "badge_percentage",
            "distinction_percentage",
            "allowed_quiz_attempts",
            "badge_bonus_points",
            "is_valid",
            listed.alias("course_count"),
            "learners_total",
            "learners_active",
            "pacing_ahead",
            "pacing_on_track",
            "pacing_behind",
            *(c for c in COUNTS.values()),
            "progress",
            "engagement",
        )
    )


def program_duration(t: Tables, as_of) -> DataFrame:
    """Schedule of each valid offering at ``as_of``."""
    return (
        valid_offerings(t)
        .select(
            "id",
            "cohort",
            schedule(
                F.col("offering_start_timestamp"), F.col("offering_end_timestamp"), as_of
            ).alias("duration"),
        )
        .select("id", "cohort", "duration.*")
    )


def _presented_dates(kind: str) -> dict[str, Column]:
    return {
        f"{end}_date": date_text(F.col(f"{kind}_offering_{end}_timestamp"))
        for end in ("start", "end")
    }


def _presented_modules() -> dict[str, Column]:
    """Fields of a module that differ from the stored columns."""
    return {
        **_presented_dates("module"),
        "module_total_points": F.col("module_total_points_defined"),
        "issue_badges": F.col("module_issue_badges_flag"),
        "badge_percentage": F.col("module_badge_percentage"),
        "allowed_quiz_attempts": F.col("module_allowed_quiz_attempts"),
        "sla_ita_attendance_points": F.col("module_sla_ita_attendance_points"),
        "badge_bonus_points": F.col("module_badge_bonus_points"),
    }


def _presented_courses() -> dict[str, Column]:
    """Fields of a course that differ from the stored columns."""
    return {
        **_presented_dates("course"),
        "course_total_points": F.col("course_total_points_defined"),
        "issue_badges": F.col("course_issue_badges_flag"),
        "badge_percentage": F.col("course_badge_percentage"),
        "allowed_quiz_attempts": F.col("course_allowed_quiz_attempts"),
        "badge_bonus_points": F.col("course_badge_bonus_points"),
        "sla_ita_attendance_points": F.col("course_sla_ita_attendance_points"),
    }


def _module_parts(t: Tables, part_size: int) -> DataFrame:
    modules = ops.program_modules(t).withColumnRenamed("course_id_fk", "course_id").select(
        *RUN, record(PROGRAM_MODULE, **_presented_modules()).alias("module")
    )
    return collect_parts(
        modules.na.drop(subset=RUN),
        RUN,
        {"modules": F.col("module")},
        parents=ops.program_courses(t).select(*RUN).distinct(),
        census=t.module_offerings.withColumnRenamed("course_id_fk", "course_id").select(
            *RUN, F.lit(1).alias("weight")
        ),
        part_size=part_size,
    )


def _course_rows(
    t: Tables, pairs: DataFrame, with_modules: bool, part_size: int
) -> DataFrame:
    """(id, cohort, piece, course, weight) per course of the given offerings, modules nested."""
    courses = (
        ops.program_courses(t)
        .withColumnRenamed("cohort_identifier_fk", "cohort")
        .withColumn("id", F.col("programme_id_fk"))
    )
    offered = courses.join(pairs, ["id", "cohort"])
    if with_modules:
        modules = _module_parts(t, part_size).select(*RUN, "part", "modules")
        offered = attach_parts(offered, modules, RUN)
    else:
        modules = PROGRAM["courses"].dataType.elementType["modules"].dataType
        offered = offered.withColumns({"part": F.lit(0), "modules": F.array().cast(modules)})
    nested = offered.select(
        "id",
        "cohort",
        F.col("part").cast("bigint").alias("piece"),
        record(PROGRAM_COURSE, **_presented_courses()).alias("course"),
        (F.size("modules") + 1).cast("bigint").alias("weight"),
    )
    # An offering without courses lists one course whose fields are null and that has no modules.
    kind = nested.schema["course"].dataType
    empty = F.struct(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[:-1]),
        F.array().cast(kind["modules"].dataType).alias("modules"),
    )
    present = courses.select("id", "cohort").distinct()
    one = F.lit(1).cast("bigint")
    without = pairs.join(present, ["id", "cohort"], "left_anti").select(
        "id", "cohort", (one - 1).alias("piece"), empty.alias("course"), one.alias("weight")
    )
    return nested.unionByName(without)


def _course_census(t: Tables, with_modules: bool) -> DataFrame:
    weight = F.lit(1)
    courses = t.course_offerings
    if with_modules:
        modules = t.module_offerings.withColumnRenamed("course_id_fk", "course_id")
        counted = modules.groupBy(*RUN).agg(F.count("*").alias("modules"))
        courses = courses.join(counted, RUN, "left")
        weight = zero_if_null("modules") + 1
    return courses.select(
        F.col("programme_id_fk").alias("id"),
        F.col("cohort_identifier_fk").alias("cohort"),
        weight.alias("weight"),
    )


def _element(field: str, *columns) -> Column:
    value = columns[0] if len(columns) == 1 else F.struct(*columns)
    return F.when(F.col("field") == field, value)


def _parts(t: Tables, listed: DataFrame | None, tree: dict, part_size: int) -> DataFrame:
    """The selected lists of each valid offering, by (id, cohort, part)."""
    pairs = valid_offerings(t).select("id", "cohort").distinct()
    elements, censuses, lists = [], [], {}
    if wants(tree, "courses"):
        with_modules = wants(tree, "courses", "modules")
        courses = _course_rows(t, pairs, with_modules, part_size)
        elements.append(
            courses.withColumns({"field": F.lit("courses"), "copies": F.lit(1).cast("bigint")})
        )
        censuses.append(_course_census(t, with_modules))
        lists["courses"] = F.col("course")
    if listed is not None:
        elements.append(
            split_copies(listed, part_size)
            .withColumn("piece", F.col("piece").cast("bigint"))
            .withColumnRenamed("programme_id", "id")
            .join(pairs, "id")
            .withColumn("weight", F.col("copies"))
        )
        lengths = listed.groupBy(F.col("programme_id").alias("id")).agg(
            F.sum("copies").alias("weight")
        )
        censuses.append(lengths.join(pairs, "id").select("id", "cohort", "weight"))
        earned = F.col("earned")
        names = F.col("first_name")
        lists |= {
            "is_alive_list": _element("is_alive_list", names),
            "access_blocked_list": _element("access_blocked_list", names),
            "lagging_courses_list": _element(
                "lagging_courses_list", names.alias("user"), "count"
            ),
            "completed_courses_list": _element(
                "completed_courses_list", "course_id", "course_name"
            ),
            "ongoing_course_progress": _element(
                "ongoing_course_progress",
                "course_name",
                "course_order_id",
                "module_order_id",
                "module_name",
                "first_name",
                earned.alias("is_badge_earned_module"),
            ),
            "programme_user_cert_status_list": _element(
                "programme_user_cert_status_list",
                "course_order_id",
                "course_name",
                "first_name",
                earned.alias("is_certificate_earned_course"),
            ),
        }
    rows, census = (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        for dfs in (elements, censuses)
    )
    return collect_parts(
        rows,
        ["id", "cohort"],
        {n: e for n, e in lists.items() if wants(tree, n)},
        ["piece"],
        copies="copies",
        weight=F.col("weight"),
        parents=pairs,
        census=census,
        part_size=part_size,
    )


def programme_documents(
    t: Tables, as_of, fields: Sequence[str] | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """The full contract: 32 fields with every list, in one or more parts per offering.

    Each row repeats the scalar fields and the list lengths of its offering; its lists hold the share
    of its ``part``.  A course whose modules fill several parts is repeated with each share.
    ``fields`` selects dotted fields; what only the others need is not computed.
    """
    tree = field_tree(fields or PROGRAM.names)
    rows = list_rows(t, as_of, [f for f, c in COUNTS.items() if f in tree or c in tree])
    listed = {f: df for f, df in rows.items() if f in tree}
    documents = _header(t, {f: df for f, df in rows.items() if COUNTS[f] in tree})
    if listed or wants(tree, "courses"):
        parts = _parts(t, _tagged(listed) if listed else None, tree, part_size)
        documents = attach_parts(documents, parts, ["id", "cohort"])
    else:
        documents = documents.withColumn("part", F.lit(0).cast("bigint"))
    if wants(tree, "courses"):
        repeated = F.flatten(F.array_repeat("courses", F.col("copies").cast("int")))
        documents = documents.withColumn(
            "courses",
            F.when(F.col("copies") == 1, F.col("courses")).otherwise(F.sort_array(repeated)),
        )
    documents = documents.withColumns(
        {
            "last_updated": date_text(F.col("last_updated")),
            "duration": schedule(
                F.col("offering_start_timestamp"), F.col("offering_end_timestamp"), as_of
            ),
            "learners": F.struct(
                F.col("learners_total").alias("total"),
                F.col("learners_active").alias("active"),
                F.struct(
                    F.col("pacing_ahead").alias("ahead"),
                    F.col("pacing_on_track").alias("on_track"),
                    F.col("pacing_behind").alias("behind"),
                ).alias("pacing"),
            ),
        }
    )
    return conform_selected(documents, PROGRAM, fields, ["part"])


def program_presentation(t: Tables, as_of) -> DataFrame:
    """The presented report as flat rows: one per offering, course and module."""
    modules = (
        ops.program_modules(t)
        .withColumnRenamed("course_id_fk", "course_id")
        .na.drop(subset=RUN)
        .select(*RUN, *prefixed("m", PROGRAM_MODULE, **_presented_modules()))
    )
    courses = ops.program_courses(t).select(
        F.col("programme_id_fk").alias("id"),
        F.col("cohort_identifier_fk").alias("cohort"),
        *RUN,
        *prefixed("c", PROGRAM_COURSE, ["modules"], **_presented_courses()),
    )
    # Equal offerings are one document that repeats its courses, so each copy stands for itself here.
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    offerings = valid_offerings(t).withColumn("copy", copies).select(
        "id",
        "cohort",
        date_text(F.col("last_updated")).alias("last_updated"),
        schedule(
            F.col("offering_start_timestamp"), F.col("offering_end_timestamp"), as_of
        ).alias("duration"),
    )
    taught = expand(courses, modules, RUN).drop(*RUN)
    rows = expand(offerings, taught, ["id", "cohort"], among=courses)
    return rows.select(
        "id",
        "cohort",
        "last_updated",
        "duration.time_elapsed",
        "duration.remaining_time",
        *(c for c in rows.columns if c.startswith(("c_", "m_"))),
    )


def flat_courses(documents: DataFrame) -> DataFrame:
    """Documents laid out as :func:`program_presentation` does."""
    nested = documents.schema["courses"].dataType.elementType
    return (
        documents.select(
            "id", "cohort", "last_updated", "duration", F.explode("courses").alias("course")
        )
        .select("*", F.explode_outer("course.modules").alias("module"))
        .select(
            "id",
            "cohort",
            "last_updated",
            "duration.time_elapsed",
            "duration.remaining_time",
            *(
                F.col(f"course.{n}").alias(f"c_{n}") for n in nested.names if n != "modules"
            ),
            *(
                F.col(f"module.{n}").alias(f"m_{n}")
                for n in nested["modules"].dataType.elementType.names
            ),
        )
    )


def flat_lists(documents: DataFrame) -> DataFrame:
    """Documents laid out as one row per element of each programme-level list."""
    fields = ("user", "count", "course_id", "course_name", "course_order_id", "module_order_id")
    fields += ("module_name", "first_name", "earned")

    def items(field: str) -> Column:
        kind = documents.schema[field].dataType.elementType

        def item(e: Column) -> Column:
            if field in ("is_alive_list", "access_blocked_list"):
                values = {"first_name": e}
            else:
                values = {n.replace("is_badge_earned_module", "earned"): e[n] for n in kind.names}
                values = {
                    n.replace("is_certificate_earned_course", "earned"): v
                    for n, v in values.items()
                }
            types = {"count": "int", "earned": "boolean"}
            types |= {"course_order_id": "int", "module_order_id": "int"}
            return F.struct(
                F.lit(field).alias("field"),
                *(
                    values.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n)
                    for n in fields
                ),
            )

        return F.transform(field, item)

    return documents.select(
        "id", "cohort", F.explode(F.concat(*(items(f) for f in COUNTS))).alias("item")
    ).select("id", "cohort", "item.*")


# Parts of the document's learners -> columns of the rollup.
ROLLED_UP = {
    "learners.total": "total_learners",
    "learners.active": "active_learners",
    "learners.pacing.ahead": "ahead_count",
    "learners.pacing.on_track": "on_track_count",
    "learners.pacing.behind": "behind_count",
}


def _beyond(counts: DataFrame, columns: Iterable[str], offerings: DataFrame) -> DataFrame:
    """The offerings of programmes with a count beyond the contract's integers; counts are never negative."""
    wrong = reduce(lambda a, b: a | b, (F.col(c) > INT_MAX for c in columns))
    return counts.where(wrong).join(offerings, "id")


def program_violations(t: Tables, as_of) -> DataFrame:
    """Every integer of the programme report, also inside its lists, that does not fit the contract.

    Counts are tested where they are counted; only those too large meet their offerings.
    """
    offerings = valid_offerings(t)
    pairs = offerings.select("id", "cohort")
    keys = {"programme_id": "id", "item_id": "cohort"}
    run = {"programme_id": "programme_id_fk", "item_id": "cohort_schedule_id"}
    name = {"programme_id": "programme_id", "user_id": "first_name"}
    lists = list_rows(t, as_of)
    # The lengths that the contract has; it has none for the last two lists.
    lengths = {f: c for f, c in COUNTS.items() if c in PROGRAM.names}
    counted = _counts(_tagged({f: lists[f].select("programme_id", "copies") for f in lengths}))
    rollup = ops.programme_rollup(t).withColumnRenamed("programme_id", "id")
    own = [n for path, n, f in fields_of(PROGRAM) if not path and f.dataType == INT]
    plain = [n for n in own if n not in ROLLED_UP and n not in COUNTS.values()]

    def renamed(fields: Iterable[str], kind: str) -> dict[str, str]:
        return {n: n if n.startswith(kind) else f"{kind}_{n}" for n in fields}

    course = renamed([f.name for f in PROGRAM_COURSE.fields if f.dataType == INT], "course")
    course["course_total_points"] = "course_total_points_defined"
    module = renamed([f.name for f in PROGRAM_MODULE.fields if f.dataType == INT], "module")
    module["module_total_points"] = "module_total_points_defined"
    levels = {
        "": [
            Level("offering", offerings, keys, only=plain),
            Level("offering", _beyond(rollup, ROLLED_UP.values(), pairs), keys, ROLLED_UP, list(ROLLED_UP)),
            Level("offering", _beyond(counted, lengths.values(), pairs), keys, only=list(lengths.values())),
        ],
        "courses": [Level("offered_course", ops.program_courses(t), run, course)],
        "courses.modules": [
            Level("offered_module", ops.program_modules(t), {**run, "item_id": "module_id"}, module)
        ],
        "lagging_courses_list": [Level("lagging_course", lists["lagging_courses_list"], name)],
        "ongoing_course_progress": [
            Level("ongoing_module", lists["ongoing_course_progress"], {**name, "item_id": "module_name"})
        ],
        "programme_user_cert_status_list": [
            Level("course_certificate", lists["programme_user_cert_status_list"], {**name, "item_id": "course_name"})
        ],
    }
    return tree_violations(PROGRAM, levels)
