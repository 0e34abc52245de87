"""Olympiad records to the five catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gavel.functions.text import empty_if_null
from gavel.operators import catalog as c
from gavel.operators.integrity import repeated_keys
from gavel.operators.joins import streamed_join, tasks_for
from gavel.operators.ordering import running_totals
from gavel.session import evaluated_once, materialized

# Collections of a record that become tables of the same name.
COUNTED = ["test_cases", "grader_files", "sub_tasks"]
LINKS = "sub_task_test_cases"
TABLES = ["problems", "test_cases", "sub_tasks", "sub_task_test_cases", "grader_files"]


def _count(column: str) -> Column:
    return F.coalesce(F.nullif(F.size(column), F.lit(-1)), F.lit(0))


@dataclass(frozen=True)
class LoadedCatalog:
    tables: dict[str, DataFrame]
    rejects: dict[str, DataFrame]


def load_catalog(
    records: DataFrame, existing: Mapping[str, DataFrame] | None = None, texts: bool = True
) -> LoadedCatalog:
    """Flatten records (with a unique ``seq``) and number every table after the existing rows.

    Records without id or year, with two sub-tasks of one name or a score out of range, records
    that repeat a (year, name), and references to unknown cases are returned as rejects. Cases and files are numbered by name within their problem,
    because the key order of a JSON object means nothing.

    ``texts=False`` is for checks of keys: the tables have the same rows and ids, but of their columns only
    ids and names (and years). No input, output, file content, score or limit is then written or shuffled.
    """
    existing = existing or {}
    unified = evaluated_once(c.unify_layout(evaluated_once(records)))
    keyed, unkeyed = c.reject_unkeyed(unified)
    keyed, bad_sub_tasks = c.reject_sub_tasks(keyed)
    # Every table below reads other columns of the records: parse them once, into columns. The links
    # of a record's sub-tasks to its cases are found inside the record, and its rows counted there.
    names = {column: F.sort_array(F.map_keys(column)) for column in ("test_cases", "grader_files")}
    counts = {f"n_{column}": _count(column) for column in COUNTED}
    own = {} if texts else names
    keyed = evaluated_once(keyed.drop("sample_solution").withColumns({"_names": names["test_cases"], **counts, **own}))
    keyed = keyed.withColumn("links", c.record_links(F.col("_names"))).drop("_names")
    if not texts:
        keyed = keyed.withColumn("sub_tasks", F.transform("sub_tasks", lambda task: empty_if_null(task["name"])))
    n_links = F.size(F.filter("links", lambda link: link["place"] > 0))
    keyed = materialized(keyed.withColumn(f"n_{LINKS}", n_links))

    names = keyed.select("seq", "year", "name")
    copies = repeated_keys(names, ["year", "name"], existing.get("problems"))
    repeated = streamed_join(names, copies, ["year", "name"], "left_semi").select("seq", "year", "name")
    # A record holds all its cases, files and sub-tasks, so an id is the problem's first one plus
    # the place in the record: only counts per problem are ordered, never a text.
    counts = keyed.select(
        "seq", "year", "name", *[F.col(f"n_{column}").alias(column) for column in [*COUNTED, LINKS]]
    )
    counts = streamed_join(counts, copies, ["year", "name"], "left_anti")
    firsts = running_totals(
        counts,
        ["seq"],
        {"before": F.lit(1), **{f"{column}_before": F.col(column) for column in [*COUNTED, LINKS]}},
        tasks=tasks_for(keyed.count(), keyed.sparkSession),
    ).select(
        "seq",
        "year",
        "name",
        (F.col("before") + c.next_id(existing.get("problems"))).alias("problem_id"),
        *[
            (F.col(f"{column}_before") + c.next_id(existing.get(column))).alias(f"first_{column}")
            for column in [*COUNTED, LINKS]
        ],
    )
    firsts = materialized(firsts)
    nested = streamed_join(keyed.select("seq", "links", *COUNTED), firsts.drop("year", "name"), "seq")

    def numbered(rows: DataFrame, column: str, *others: str) -> DataFrame:
        known = rows.withColumn("id", F.col(f"first_{column}") + F.col("position"))
        return known.select("id", "problem_id", "name", *others)

    def names_of(column: str) -> DataFrame:
        each = F.posexplode(column).alias("position", "name")
        return numbered(nested.select("problem_id", f"first_{column}", each), column)

    links = nested.select(
        "problem_id", "first_test_cases", "first_sub_tasks", f"first_{LINKS}",
        F.posexplode(F.filter("links", lambda link: link["place"] > 0)).alias("position", "link"),
    )
    missing = nested.select(
        "problem_id", "first_sub_tasks",
        F.explode(F.filter("links", lambda link: link["place"] == 0)).alias("link"),
    )
    tables = {
        "problems": firsts.select(F.col("problem_id").alias("id"), "year", "name"),
        **({column: names_of(column) for column in COUNTED} if not texts else {
            "test_cases": numbered(c.named_cases(nested), "test_cases", "input", "output"),
            "sub_tasks": numbered(c.sub_tasks(nested), "sub_tasks", "score", "time_limit", "memory_limit"),
            "grader_files": numbered(c.grader_files(nested), "grader_files", "content"),
        }),
        LINKS: links.select(
            (F.col(f"first_{LINKS}") + F.col("position")).alias("id"),
            (F.col("first_sub_tasks") + F.col("link.sub_task")).alias("sub_task_id"),
            (F.col("first_test_cases") + F.col("link.place") - 1).alias("test_case_id"),
        ),
    }
    rejects = {
        "unkeyed": unkeyed,
        "sub_tasks": bad_sub_tasks,
        "repeated": repeated,
        "missing_case_refs": missing.select(
            "problem_id",
            F.col("link.case_name").alias("case_name"),
            F.col("link.sub_task").alias("position"),
            (F.col("first_sub_tasks") + F.col("link.sub_task")).alias("id"),
            F.col("link.case_position").alias("case_position"),
        ),
    }
    return LoadedCatalog(tables, rejects)
