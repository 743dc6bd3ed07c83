"""Learner report: programme header, learners, their courses and their modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import date_text, time_spent_text, zero_if_null
from cohortlens.operators import learners as ops
from cohortlens.operators.contract import (
    Level,
    conform,
    conform_selected,
    field_tree,
    quarantine,
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
)
from cohortlens.operators.ranking import stored
from cohortlens.schemas import (
    CERTIFICATES,
    INPUTS,
    INT,
    LEARNER,
    LEARNER_COURSE,
    LEARNER_MODULE,
    LEARNER_PROGRESS,
    PROGRAMME_COLUMN,
)
from cohortlens.sources.tables import Tables

LEARNER_KEY = ["programme_id", "user_id"]
COURSE_KEY = ["programme_id", "user_id", "course_id"]


def _header(t: Tables) -> DataFrame:
    return (
        ops.programme_info(t)
        .join(ops.programme_performance(t), "programme_id", "left")
        .select(
            F.col("programme_id").alias("id"),
            F.col("programme_name").alias("name"),
            F.col("offering_status").alias("status"),
            zero_if_null("completion_certificates").alias("completion_certificates"),
            zero_if_null("distinction_certificates").alias("distinction_certificates"),
            F.coalesce("performance", F.lit(0.0)).alias("performance"),
            zero_if_null("defined_total_course_certificates").alias("total_course_certificates"),
            "total_badges",
        )
    )


def _first_offerings(header: DataFrame) -> DataFrame:
    order = ["status", *(c for c in header.columns if c not in ("id", "status"))]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return header.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def learner_progress(t: Tables) -> DataFrame:
    """Flat header per programme offering, with the number of learners listed."""
    learners = (
        t.programme_facts.join(t.users.select("user_id"), "user_id")
        .groupBy(F.col("programme_id").alias("id"))
        .agg(F.count("*").alias("learner_count"))
    )
    return (
        _header(t)
        .join(learners, "id", "left")
        .withColumn("learner_count", zero_if_null("learner_count"))
    )


def _census(t: Tables) -> DataFrame:
    """Modules and runs of every learner's courses, stored: each fact is counted once for all levels of lists."""
    programme = F.col("programme_id_fk").alias("programme_id")
    course = [programme, "user_id"]
    modules = t.module_facts.groupBy(*course, F.col("course_id_fk").alias("course_id")).agg(
        F.count("*").alias("modules"), F.lit(0).cast("bigint").alias("runs")
    )
    runs = t.course_facts.groupBy(*course, "course_id").agg(
        F.lit(0).cast("bigint").alias("modules"), F.count("*").alias("runs")
    )
    return stored(modules.unionAll(runs), "census")


def _presented_modules() -> dict[str, Column]:
    """Fields of a module that differ from the columns of the block."""
    return {
        "id": F.col("module_id"),
        "name": F.col("module_name"),
        "time_spent": time_spent_text(F.col("time_spent_seconds_module")),
        "total_points": F.col("module_total_points_defined"),
        "start_date": date_text(F.col("module_offering_start_timestamp")),
    }


def _presented_courses() -> dict[str, Column]:
    """Fields of a course that differ from the columns of the block."""
    return {
        "id": F.col("course_id"),
        "name": F.col("course_name"),
        "time_spent": time_spent_text(F.col("time_spent_seconds_course")),
        "total_points": F.col("course_total_points_defined"),
        "start_date": date_text(F.col("course_offering_start_timestamp")),
    }


def _presented_learners() -> dict[str, Column]:
    """Fields of a learner that differ from the columns of the block."""
    return {
        "id": F.col("user_id"),
        "time_spent": time_spent_text(F.col("time_spent_seconds")),
        "last_active": date_text(F.col("last_active")),
        "completion": F.col("completion_certificate"),
        "distinction": F.col("distinction_certificate"),
    }


def _module_parts(t: Tables, part_size: int, census: DataFrame) -> DataFrame:
    modules = ops.learner_modules(t).select(
        "programme_id",
        "user_id",
        F.col("course_id_fk").alias("course_id"),
        record(LEARNER_MODULE, **_presented_modules()).alias("module"),
    )
    return collect_parts(
        modules.na.drop(subset=COURSE_KEY),
        COURSE_KEY,
        {"modules": F.col("module")},
        parents=ops.learner_courses(t).select(*COURSE_KEY).distinct(),
        census=census.select(*COURSE_KEY, F.col("modules").alias("weight")),
        part_size=part_size,
    )


def _course_parts(t: Tables, with_modules: bool, part_size: int, census: DataFrame) -> DataFrame:
    courses = ops.learner_courses(t)
    if with_modules:
        modules = _module_parts(t, part_size, census).select(*COURSE_KEY, "part", "modules")
        courses = attach_parts(courses, modules, COURSE_KEY)
    else:
        kind = LEARNER["courses"].dataType.elementType["modules"].dataType
        courses = courses.withColumns({"part": F.lit(0), "modules": F.array().cast(kind)})
    courses = courses.select(
        *LEARNER_KEY,
        "cohort_schedule_id",
        "part",
        record(LEARNER_COURSE, **_presented_courses()).alias("course"),
    )
    return collect_parts(
        courses.na.drop(subset=LEARNER_KEY),
        LEARNER_KEY,
        {"courses": F.col("course")},
        ["cohort_schedule_id", "part"],
        weight=F.size("course.modules") + 1,
        parents=t.programme_facts.select(*LEARNER_KEY).distinct(),
        census=census.select(*LEARNER_KEY, (F.col("modules") + F.col("runs")).alias("weight")),
        part_size=part_size,
    )


# Columns of the learner block behind the contract's required fields and integers.
_REQUIRED = ("user_id", "name", "email", "status", "progress", "engagement", "performance")
_INTEGERS = (
    "achieved_points",
    "badges",
    "total_points",
    "course_certificates_earned",
    "completion_certificate",
    "distinction_certificate",
)


def _sound_learners(t: Tables) -> DataFrame:
    """The learner block; one who breaks the contract is set aside, ``learner_violations`` tells why."""
    return quarantine(ops.learner_data(t), _REQUIRED, _INTEGERS)[0]


def _facts_of(t: Tables, learners: DataFrame, how: str) -> Tables:
    """The tables with the facts of some learners alone (``left_semi``), or without theirs (``left_anti``)."""
    facts = {INPUTS[key][0]: key for key in ("programme_facts", "course_facts", "module_facts")}
    chosen = learners.select(*(F.col(k).alias(f"_{k}") for k in LEARNER_KEY))

    def resolve(name: str) -> DataFrame:
        if name not in facts:
            return t.table(name)
        df = getattr(t, facts[name])
        programme = df[PROGRAMME_COLUMN[facts[name]]]
        same = programme.eqNullSafe(chosen["_programme_id"]) & df["user_id"].eqNullSafe(chosen["_user_id"])
        return df.join(chosen, same, how)

    return Tables(resolve)


def _learners_in_parts(t: Tables, with_modules: bool, part_size: int, census: DataFrame) -> DataFrame:
    """Learners with their courses, for any number of these: each level is cut into parts of its own."""
    parts = _course_parts(t, with_modules, part_size, census)
    return attach_parts(_sound_learners(t), parts.withColumnRenamed("part", "learner_part"), LEARNER_KEY)


def _gathered_learners(t: Tables, with_modules: bool, part_size: int) -> DataFrame:
    """Learners with their courses, where all modules and course runs of one fit in a part.

    Modules, courses and learners are dealt once, by learner, and gathered level by level where they are; the lists are
    those of :func:`_learners_in_parts`.
    """
    learners = _sound_learners(t)
    fields = [c for c in learners.columns if c not in LEARNER_KEY]
    learners = learners.select(*LEARNER_KEY, F.struct(*fields).alias("learner"))
    plain = [n for n in LEARNER_COURSE.names if n != "modules"]
    shown = {n: _presented_courses().get(n, F.col(n)).alias(n) for n in plain}
    courses = ops.learner_courses(t).na.drop(subset=LEARNER_KEY)
    courses = courses.select(
        *COURSE_KEY, F.struct(*shown.values(), F.col("cohort_schedule_id").alias("_run")).alias("course")
    )
    rows = learners.unionByName(courses, allowMissingColumns=True)
    if with_modules:
        modules = ops.learner_modules(t).withColumnRenamed("course_id_fk", "course_id").na.drop(subset=COURSE_KEY)
        modules = modules.select(*COURSE_KEY, record(LEARNER_MODULE, **_presented_modules()).alias("module"))
        rows = rows.unionByName(modules, allowMissingColumns=True)
    else:
        kind = LEARNER["courses"].dataType.elementType["modules"].dataType
        rows = rows.withColumn("module", F.lit(None).cast(kind.elementType))
    taken = (
        rows.repartition(*LEARNER_KEY)
        .groupBy(*COURSE_KEY)
        .agg(
            F.sort_array(F.collect_list("module")).alias("modules"),
            F.collect_list("course").alias("courses"),
            F.collect_list("learner").alias("learners"),
        )
    )

    def placed(course: Column) -> Column:
        """What a course is sorted by, as ``collect_parts`` does, and the course."""
        place = F.struct(*(course[n].alias(n) for n in plain), course["_run"].alias("_run"))
        held = (F.col("modules") if n == "modules" else course[n] for n in LEARNER_COURSE.names)
        element = F.struct(*(c.alias(n) for c, n in zip(held, LEARNER_COURSE.names, strict=True)))
        return F.struct(place.alias("place"), element.alias("element"))

    size = F.size("courses") * F.least(F.size("modules") + 1, F.lit(part_size))
    gathered = taken.groupBy(*LEARNER_KEY).agg(
        F.sort_array(F.flatten(F.collect_list(F.transform("courses", placed)))).alias("courses"),
        F.flatten(F.collect_list("learners")).alias("learners"),
        F.sum(size).cast("bigint").alias("part_weight"),
    )
    # Courses of no learner end here, like modules of no course above.
    return gathered.select(
        *LEARNER_KEY,
        F.explode("learners").alias("learner"),
        F.transform("courses", lambda x: x["element"]).alias("courses"),
        F.lit(0).cast("bigint").alias("learner_part"),
        "part_weight",
    ).select(*LEARNER_KEY, *(F.col(f"learner.{c}").alias(c) for c in fields), "courses", "learner_part", "part_weight")


def learner_documents(
    t: Tables,
    tree: dict | None = None,
    part_size: int = PART_SIZE,
    census: DataFrame | None = None,
) -> DataFrame:
    """One nested learner per row; a learner whose courses fill several parts has several rows.

    ``tree`` selects fields of the learner; unless it includes the courses, or their modules, these
    are left empty and not computed.  ``census`` is what :func:`_census` returns, if it is known.
    """
    tree = tree or {}
    if wants(tree, "courses"):
        census = _census(t) if census is None else census
        with_modules = wants(tree, "courses", "modules")
        weights = census.groupBy(*LEARNER_KEY).agg(F.sum(F.col("modules") + F.col("runs")).alias("weight"))
        large = stored(weights.where(F.col("weight") > part_size).select(*LEARNER_KEY), "large-learners")
        if large.isEmpty():
            learners = _gathered_learners(t, with_modules, part_size)
        else:
            learners = _gathered_learners(_facts_of(t, large, "left_anti"), with_modules, part_size)
            apart = _learners_in_parts(_facts_of(t, large, "left_semi"), with_modules, part_size, census)
            learners = learners.unionByName(apart)
    else:
        learners = _sound_learners(t).withColumns(
            {
                "courses": F.array().cast(LEARNER["courses"].dataType),
                "learner_part": F.lit(0),
                "part_weight": F.lit(0),
            }
        )
    return learners.select(
        "programme_id",
        "learner_part",
        record(
            LEARNER,
            **_presented_learners(),
            certificates=record(CERTIFICATES, **_presented_learners()),
        ).alias("learner"),
        (F.col("part_weight") + 1).alias("weight"),
    )


def conformed_headers(t: Tables, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Offerings' headers that keep the contract, and those that break it.

    With ``first_only`` a programme's first offering is taken before it is judged, as a single answer would be.
    """
    kinds = {f.name: f.dataType for f in LEARNER_PROGRESS.fields if f.name != "learner_data"}
    header = _first_offerings(_header(t)) if first_only else _header(t)
    return quarantine(header, kinds, [n for n, kind in kinds.items() if kind == INT])


def learner_progress_documents(
    t: Tables,
    programme_id: str | None = None,
    fields: Sequence[str] | None = None,
    first_only: bool = False,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """The full contract: nine fields with the nested learners, in one or more parts per offering.

    With ``programme_id`` the answer is that programme's first offering by status, or no row if the
    programme is unknown or its first offering breaks the contract.  Without it every programme is returned, with all
    its offerings or, if ``first_only``, with the first.  A programme without learners has an empty list.
    ``fields`` selects dotted fields; what only the others need is not computed.  Offerings and learners that break the
    contract are set aside: :func:`conformed_headers` and :func:`conformed_learners` return them.
    """
    tree = field_tree(fields or LEARNER_PROGRESS.names)
    if programme_id is not None:
        t = t.for_programme(programme_id)
    documents, _ = conformed_headers(t, first_only or programme_id is not None)
    if wants(tree, "learner_data"):
        census = _census(t)
        listed = learner_documents(t, tree["learner_data"], part_size, census)
        # A learner's own row counts as well.
        weights = census.select(F.col("programme_id").alias("id"), (F.col("modules") + F.col("runs")).alias("weight"))
        own = t.programme_facts.select(F.col("programme_id").alias("id"), F.lit(1).cast("bigint").alias("weight"))
        parts = collect_parts(
            listed.withColumnRenamed("programme_id", "id"),
            ["id"],
            {"learner_data": F.col("learner")},
            ["learner_part"],
            weight=F.col("weight"),
            parents=t.programmes.select(F.col("programme_id").alias("id")).distinct(),
            census=weights.unionAll(own) if wants(tree, "learner_data", "courses") else own,
            part_size=part_size,
        )
        # Stored, so that Spark knows before it deals the nested rows how small the headers are.
        documents = stored(documents, "headers")
        documents = attach_parts(documents, parts.select("id", "part", "learner_data"), ["id"])
    else:
        documents = documents.withColumn("part", F.lit(0).cast("bigint"))
    return conform_selected(documents, LEARNER_PROGRESS, fields, ["part"])


# A task returns at most this many counts of facts.
COUNTERS = 65_536

# What a course run and a module are shown from: columns of their blocks.
_RUN_COLUMNS = (
    "course_name",
    "progress",
    "engagement",
    "performance",
    "certificate_earned",
    "time_spent_seconds_course",
    "achieved_points",
    "course_total_points_defined",
    "total_badges",
    "certificate_pass_percentage",
    "course_offering_start_timestamp",
)
_MODULE_COLUMNS = (
    "module_id",
    "module_name",
    "engagement",
    "progress",
    "performance",
    "badge",
    "bonus_points",
    "time_spent_seconds_module",
    "achieved_points",
    "module_total_points_defined",
    "module_offering_start_timestamp",
)


def _large_learners(t: Tables, most: int) -> DataFrame | None:
    """Learners with more than ``most`` facts, stored; None if there are none.

    Facts are counted by a hash of their learner, of which a task returns at most ``COUNTERS`` numbers.  Only where
    one of these exceeds ``most`` the learners themselves are counted.
    """
    programme = F.col("programme_id_fk").alias("programme_id")
    facts = t.module_facts.select(programme, "user_id").unionAll(t.course_facts.select(programme, "user_id"))
    facts = facts.unionAll(t.programme_facts.select(*LEARNER_KEY)).na.drop()
    facts = facts.withColumn("_counter", F.pmod(F.xxhash64(*LEARNER_KEY), F.lit(COUNTERS)).cast("int"))
    full = stored(facts.groupBy("_counter").agg(F.count("*").alias("_facts")).where(F.col("_facts") > most), "counters")
    if full.isEmpty():
        return None
    counted = facts.join(full, "_counter", "left_semi").groupBy(*LEARNER_KEY).agg(F.count("*").alias("_facts"))
    large = stored(counted.where(F.col("_facts") > most).select(*LEARNER_KEY), "large-learners")
    return None if large.isEmpty() else large


def _course_rows(t: Tables) -> DataFrame:
    """Learners' course runs, each with the modules of the course, as flat rows; one without modules has a row.

    Modules and runs are dealt once, by learner, as they are in the blocks, and meet where they are: a row of the
    presentation is not shuffled.
    """
    run = ops.learner_courses(t).na.drop(subset=LEARNER_KEY)
    run = run.select(*COURSE_KEY, F.struct(*_RUN_COLUMNS).alias("run"))
    modules = ops.learner_modules(t).withColumnRenamed("course_id_fk", "course_id").na.drop(subset=COURSE_KEY)
    modules = modules.select(*COURSE_KEY, F.struct(*_MODULE_COLUMNS).alias("module"))
    dealt = run.unionByName(modules, allowMissingColumns=True).repartition(*LEARNER_KEY)

    # Of each course the runs come first, then the modules.
    course = Window.partitionBy(*COURSE_KEY).orderBy(F.col("module").isNotNull())
    before = course.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = course.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = F.when(F.col("module").isNotNull(), F.col("_runs")).when(F.col("_modules") == 0, F.array("run"))
    rows = (
        dealt.withColumns({"_runs": F.collect_list("run").over(before), "_modules": F.count("module").over(whole)})
        # A module of a course that its learner has no run of ends here.
        .select(*COURSE_KEY, "module", F.explode(runs).alias("run"))
        .select(*COURSE_KEY, "module", "run.*")
        .select(*LEARNER_KEY, "module", *prefixed("c", LEARNER_COURSE, ["modules"], **_presented_courses()))
    )
    shown = prefixed("m", LEARNER_MODULE, **_presented_modules())
    names = [f"m_{n}" for n in LEARNER_MODULE.names]
    kept = [*LEARNER_KEY, *(c for c in rows.columns if c.startswith("c_"))]
    there = F.col("module").isNotNull()
    return rows.select(*kept, "module", "module.*").select(
        *kept, *(F.when(there, c).alias(n) for c, n in zip(shown, names, strict=True))
    )


def _split_course_rows(t: Tables) -> DataFrame:
    """:func:`_course_rows` for learners with any share of the rows, by joins that are split where they are hot."""
    modules = ops.learner_modules(t).withColumnRenamed("course_id_fk", "course_id")
    modules = modules.na.drop(subset=COURSE_KEY).select(
        *COURSE_KEY, *prefixed("m", LEARNER_MODULE, **_presented_modules())
    )
    courses = ops.learner_courses(t).select(
        *COURSE_KEY, *prefixed("c", LEARNER_COURSE, ["modules"], **_presented_courses())
    )
    return expand(courses, modules, COURSE_KEY).drop("course_id")


def learner_presentation(t: Tables, part_size: int = PART_SIZE) -> DataFrame:
    """The presented report as flat rows: one per offering, learner, course and module.

    Learners with more than ``part_size`` facts are joined apart; the rows are the same.
    """
    header = ops.programme_info(t).select(F.col("programme_id").alias("id"), F.col("offering_status").alias("status"))
    # Stored, so that Spark knows how small it is; it meets the learners, which are fewer than the rows.
    header = stored(header, "headers")

    def learners(t: Tables) -> DataFrame:
        found = ops.learner_data(t).select(*LEARNER_KEY, *prefixed("l", LEARNER_ROW, **_presented_learners()))
        return found.join(header.withColumnRenamed("id", "programme_id"), "programme_id")

    large = _large_learners(t, part_size)
    others = t if large is None else _facts_of(t, large, "left_anti")
    rows = learners(others).join(_course_rows(others), LEARNER_KEY, "left")
    if large is not None:
        some = _facts_of(t, large, "left_semi")
        # Every course is taken, so the courses tell which learners have none.
        apart = expand(learners(some), _split_course_rows(some), LEARNER_KEY, among=ops.learner_courses(some))
        rows = rows.unionByName(apart)
    rows = rows.withColumnRenamed("programme_id", "id").drop("user_id")
    return rows.select(*(c for c in rows.columns if c != "status"), "status")


def flat_learners(documents: DataFrame) -> DataFrame:
    """Documents laid out as :func:`learner_presentation` does; one without learners has a row of its own."""
    kinds = {"l": documents.schema["learner_data"].dataType.elementType}
    kinds["c"] = kinds["l"]["courses"].dataType.elementType
    kinds["m"] = kinds["c"]["modules"].dataType.elementType
    nested = ("certificates", "courses", "modules")
    return (
        documents.select("id", "status", F.explode_outer("learner_data").alias("l"))
        .select("*", F.explode_outer("l.courses").alias("c"))
        .select("*", F.explode_outer("c.modules").alias("m"))
        .select(
            "id",
            "status",
            *(
                F.col(f"{level}.{n}").alias(f"{level}_{n}")
                for level, kind in kinds.items()
                for n in kind.names
                if n not in nested
            ),
            *(F.col(f"l.certificates.{n}").alias(f"l_{n}") for n in CERTIFICATES.names),
        )
    )


LEARNER_ROW = T.StructType(
    [f for f in LEARNER.fields if f.name not in ("courses", "certificates")] + CERTIFICATES.fields
)


def learner_rows(t: Tables) -> DataFrame:
    """Flat learners in the contract's fields, not yet converted to its types."""
    fields = _presented_learners()
    return ops.learner_data(t).select(
        "programme_id", *(fields.get(n, F.col(n)).alias(n) for n in LEARNER_ROW.names)
    )


def conformed_learners(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Typed flat learners that keep the contract, and the untyped ones that break it."""
    required = [f.name for f in LEARNER_ROW.fields if not f.nullable]
    integers = [f.name for f in LEARNER_ROW.fields if f.dataType == INT]
    good, broken = quarantine(learner_rows(t), required, integers)
    return conform(good, LEARNER_ROW, ["programme_id"]), broken


def learner_violations(t: Tables) -> DataFrame:
    """Every field of the learner report that breaks the contract, also inside its lists."""
    user = {"programme_id": "programme_id", "user_id": "user_id"}
    certificates = {f"certificates.{n}": n for n in CERTIFICATES.names}
    levels = {
        "": [Level("programme", _header(t), {"programme_id": "id"})],
        "learner_data": [
            Level("learner", learner_rows(t), {"programme_id": "programme_id", "user_id": "id"}, certificates)
        ],
        "learner_data.courses": [
            Level(
                "course",
                ops.learner_courses(t),
                {**user, "item_id": "cohort_schedule_id"},
                {"total_points": "course_total_points_defined"},
            )
        ],
        "learner_data.courses.modules": [
            Level(
                "module",
                ops.learner_modules(t),
                {**user, "item_id": "module_id"},
                {"total_points": "module_total_points_defined"},
            )
        ],
    }
    return tree_violations(LEARNER_PROGRESS, levels)
