"""What has to be compiled and run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.text import strip
from gavel.operators.ordering import followed, row_numbers, running_totals
from gavel.operators.rejects import split_rejects
from gavel.session import materialized

# Default limits.
DEFAULT_SECONDS = 1.0
DEFAULT_MEMORY_MB = 256
BYTES_PER_MB = 1024 * 1024
RUN_TIME_FACTOR = 2
WALL_TIME_FACTOR = 4

# Problems with a way of running of their own.
ONE_SOLUTION_WITH_MANAGER = {(2022, "insects"), (2022, "towns"), (2024, "sphinx")}
TWO_SOLUTIONS_WITH_MANAGER = {(2024, "message")}
TWO_SOLUTIONS_FIFO = {(2020, "stations")}
NEEDS_TIME_HEADER = {(2023, "longesttrip")}
TIME_HEADER = "#include <ctime>\n"

# Problem types that can be routed.
PROBLEM_TYPES = ["cpp_oj", "compile_cpp", "run_program", "compile_ioi_binary"]

BATCH_SIZE = 200

TASK_KEY = ["problem_id", "case_name", "time_limit", "memory_limit"]


def sub_task_cases(sub_tasks: DataFrame) -> DataFrame:
    """One row per case a sub-task names, with the sub-task's limits; repeats are kept."""
    return sub_tasks.select(
        "problem_id",
        F.col("position").alias("sub_task_position"),
        F.col("name").alias("sub_task"),
        F.col("score").cast("double").alias("points"),
        "time_limit",
        "memory_limit",
        F.posexplode("test_case_names").alias("case_position", "case_name"),
    )


def judge_tasks(cases: DataFrame) -> DataFrame:
    """Distinct (problem, case, limits): a case shared by sub-tasks runs once per limits."""
    return (
        cases.select(*TASK_KEY)
        .distinct()
        .withColumn("memory_limit_mb", F.ceil(F.col("memory_limit") / BYTES_PER_MB))
    )


def effective_limits(tasks: DataFrame) -> DataFrame:
    """Limits the runner is started with, and those of a test specification."""
    seconds = F.coalesce("time_limit", F.lit(DEFAULT_SECONDS))
    return (
        tasks.withColumn("run_seconds", seconds * RUN_TIME_FACTOR)
        .withColumn("wall_seconds", seconds * RUN_TIME_FACTOR * WALL_TIME_FACTOR)
        .withColumn("run_memory_mb", F.coalesce("memory_limit_mb", F.lit(DEFAULT_MEMORY_MB)))
        .withColumn(
            "spec_seconds",
            F.coalesce(F.nullif(F.col("time_limit"), F.lit(0.0)), F.lit(DEFAULT_SECONDS)),
        )
        .withColumn(
            "spec_memory_mb",
            F.coalesce(F.nullif(F.col("memory_limit_mb"), F.lit(0)), F.lit(DEFAULT_MEMORY_MB)),
        )
    )


def test_specs(cases: DataFrame) -> DataFrame:
    """Cases (``name, position, input, output`` and optional limits) as JSON ``spec`` lines.

    ``position`` is 0-based within the suite; a blank name becomes its 1-based number.
    """
    trimmed = strip(F.coalesce("name", F.lit("")))
    name = F.when(trimmed == "", F.format_string("test-%03d", F.col("position") + 1)).otherwise(
        trimmed
    )
    named = cases.withColumn("name", name)

    def encoded(column: str) -> Column:
        # Sessions may break base64 into lines of 76; the format is one unbroken text.
        return F.replace(F.base64(column), F.lit("\r\n"), F.lit("")).alias(column)

    fields = ["name", encoded("input"), encoded("output")]
    if "time_limit" in cases.columns:
        seconds = F.format_string("%.4fs", "time_limit")
        fields.append(F.when(F.col("time_limit").isNotNull(), seconds).alias("time_limit"))
    if "memory_limit_mb" in cases.columns:
        fields.append(F.col("memory_limit_mb").alias("memory_limit_in_mb"))
    return named.withColumn("spec", F.to_json(F.struct(*fields)))


test_specs.__test__ = False  # not a test, whatever its name


def spec_seconds(time_limit: Column) -> Column:
    """Seconds from either form of a specification's limit: ``"1.0000s"`` or nanoseconds."""
    text = strip(time_limit.cast("string"))
    from_text = F.when(text.rlike(r"^\d+(\.\d+)?s$"), F.rtrim(text, F.lit("s")).try_cast("double"))
    from_nanos = F.when(text.rlike(r"^\d+$"), text.try_cast("double") / 1e9)
    return F.coalesce(from_text, from_nanos)


def is_source(name: Column) -> Column:
    return name.endswith(".cpp") | name.endswith(".c")


def compile_plan(files: DataFrame) -> DataFrame:
    """Per problem of ``problem_id, name`` rows: main source, targets and what is missing."""

    def has(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("name") == name), F.lit(False))

    flags = files.groupBy("problem_id").agg(
        has("stub.cpp").alias("has_stub"),
        has("grader.cpp").alias("has_grader"),
        has("checker.cpp").alias("builds_checker"),
        has("manager.cpp").alias("builds_manager"),
        has("testlib.h").alias("has_testlib"),
        F.count_if(is_source(F.col("name"))).alias("n_sources"),
    )
    main = F.when(F.col("has_stub"), "stub.cpp").when(F.col("has_grader"), "grader.cpp")
    return flags.select(
        "problem_id",
        main.alias("main_source"),
        "builds_checker",
        "builds_manager",
        "has_testlib",
        "n_sources",
        F.when(main.isNull(), "no stub.cpp or grader.cpp found").alias("error"),
    )


def generic_sources(files: DataFrame) -> DataFrame:
    """Files of a plain C++ job that go on the compiler's command line."""
    return files.filter(is_source(F.col("name")))


def _is_one_of(pairs: set[tuple[int, str]]) -> Column:
    key = F.struct(F.col("year").cast("int"), F.col("name"))
    return key.isin([F.struct(F.lit(year), F.lit(name)) for year, name in sorted(pairs)])


def solution_sources(
    problems: DataFrame, submitted: DataFrame | None = None, on_error: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """``(problems with a solution, rejects)``: the submitted solution, else the sample one."""
    if submitted is None:
        chosen = problems.withColumn("solution", F.col("sample_solution"))
    else:
        given = submitted.select("problem_id", F.col("solution").alias("_submitted"))
        chosen = problems.join(given, "problem_id", "left").withColumn(
            "solution", F.coalesce("_submitted", "sample_solution")
        ).drop("_submitted")
    patched = chosen.withColumn(
        "solution",
        F.when(_is_one_of(NEEDS_TIME_HEADER), F.concat(F.lit(TIME_HEADER), "solution")).otherwise(
            F.col("solution")
        ),
    )
    return split_rejects(
        patched, F.when(F.col("solution").isNull(), "no solution given or sampled"), on_error
    )


def run_mode(problems: DataFrame) -> DataFrame:
    """How a problem's programs are wired together; the first rule that fits.

    Needs ``year, name, builds_checker, builds_manager, has_testlib`` and ``has_solution``.
    """
    checker, manager = F.col("builds_checker"), F.col("builds_manager")
    mode = (
        F.when(_is_one_of(ONE_SOLUTION_WITH_MANAGER), "manager, stdio")
        .when(_is_one_of(TWO_SOLUTIONS_WITH_MANAGER), "manager, two solutions, background")
        .when(checker & ~manager, "batch, checker")
        .when(manager & ~checker & F.col("has_testlib"), "manager, fifo arguments")
        .when(manager & ~checker & _is_one_of(TWO_SOLUTIONS_FIFO), "manager, two solutions, fifo arguments")
        .when(manager & ~checker, "manager, two solutions, stdio")
        .when(manager & checker & F.col("has_solution"), "manager, then checker")
        .otherwise("unsupported")
    )
    return problems.withColumn("run_mode", mode)


def route_jobs(
    jobs: DataFrame, queues: Mapping[str, str], on_error: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """``(jobs with a queue, rejects)`` by the queue registered for each problem type."""
    unknown = set(queues) - set(PROBLEM_TYPES)
    if unknown:
        raise ValueError(f"unknown problem types: {sorted(unknown)}")
    queue = F.lit(None).cast("string")
    if queues:
        routes = F.create_map(*[F.lit(part) for pair in queues.items() for part in pair])
        queue = F.try_element_at(routes, F.col("problem_type"))
    reason = F.when(
        F.col("problem_type").isNull() | ~F.col("problem_type").isin(PROBLEM_TYPES),
        "unsupported problem type",
    ).when(F.col("queue").isNull(), "no queue registered")
    return split_rejects(jobs.withColumn("queue", queue), reason, on_error)


def batch_requests(
    requests: DataFrame,
    order_by: list[str],
    size: int = BATCH_SIZE,
    max_delay_seconds: float | None = None,
) -> DataFrame:
    """Cut requests, in the total order ``order_by``, into batches numbered from 0.

    Adds ``batch`` and ``batch_pos``. A batch closes with ``size`` requests; given
    ``max_delay_seconds``, also with the last request less than that after its first one, and
    ``order_by`` then begins with the time (a request without a time is a batch of its own).
    Only the keys are ranged and numbered; the requests, binaries included, join in by them.
    """
    keys = requests.select(*order_by)
    if max_delay_seconds is None:
        numbered = row_numbers(keys, order_by, "_number", start=0).select(
            *order_by,
            F.floor(F.col("_number") / size).alias("batch"),
            (F.col("_number") % size).alias("batch_pos"),
        )
    else:
        numbered = _delayed_batches(keys, order_by, size, max_delay_seconds)
    numbered = numbered.withColumnsRenamed({c: f"_key_{c}" for c in order_by})
    same = F.lit(True)
    for c in order_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return requests.join(numbered, same).select(*requests.columns, "batch", "batch_pos")


def _delayed_batches(keys: DataFrame, order_by: list[str], size: int, seconds: float) -> DataFrame:
    """``keys`` with ``batch`` and ``batch_pos``.

    Every request points at the one that would follow a batch beginning with it: the first that
    is not in time, or the next one after ``size``. One sorted table of requests and deadlines gives
    all pointers, as the n-th deadline is that of the n-th request. The batches that there are begin on
    the chain from the first request, which is followed by doubling.
    """
    moment = F.col(order_by[0])
    late = moment + F.make_dt_interval(secs=F.lit(seconds))
    # A deadline comes before the requests of its moment.
    events = keys.withColumn("_row", F.lit(1)).unionAll(
        keys.withColumn(order_by[0], late).withColumn("_row", F.lit(0))
    )
    counted = materialized(
        running_totals(
            events, [order_by[0], "_row", *order_by[1:]], {"_rows": F.col("_row"), "_ends": 1 - F.col("_row")}
        )
    )
    steps = counted.filter("_row = 0").select(
        F.col("_ends").alias("node"),
        F.greatest(
            F.col("_ends") + 1, F.least(F.col("_ends") + size, F.when(moment.isNotNull(), F.col("_rows")).otherwise(0))
        ).alias("next"),
    )
    begun = followed(steps, steps.filter("node = 0").select("node"))
    batches = row_numbers(begun.join(steps, "node"), ["node"], "batch", 0)
    places = batches.select(
        "batch", F.col("node").alias("_first"), F.explode(F.sequence("node", F.col("next") - 1)).alias("_rows")
    )
    return counted.filter("_row = 1").join(places, "_rows").select(
        *order_by, "batch", (F.col("_rows") - F.col("_first")).alias("batch_pos")
    )
