"""Catalogue tables as versions of Parquet folders, bucketed by what they are looked up by."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

# How each table is looked up. Keys of child tables begin with the parent and go on
# with the name, so that one huge parent spans many files or buckets.
TABLE_ORDER = {
    "problems": ["id"],
    "test_cases": ["problem_id", "name"],
    "sub_tasks": ["problem_id", "name"],
    "sub_task_test_cases": ["sub_task_id", "id"],
    "grader_files": ["problem_id", "name"],
    "contest_problems": ["id"],
    "contest_cases": ["problem_id", "case_offset"],
}
_MANIFEST = "version bigint, name string, folder string, buckets int"


def _manifest(spark: SparkSession, path: str) -> list:
    """Rows of the newest version: one per table and folder."""
    try:
        listed = spark.read.schema(_MANIFEST).parquet(f"{path}/_versions")
        newest = listed.agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing has been written yet
        newest = None
    return [] if newest is None else listed.filter(F.col("version") == newest).collect()


def write_catalog(
    tables: Mapping[str, DataFrame], path: str, drop: bool = False, buckets: int | None = None
) -> None:
    """Write tables under ``path``; ``drop`` replaces those that are there, else rows are added.

    Rows go to new folders, and what is there is not touched. The last step is one small file that names
    the folders of all tables, so readers see all of a write or none of it, a failure half-way leaves
    the version before, and a catalogue may be replaced by what was read from itself. Folders no
    version needs stay until they are removed by hand. There may be one writer at a time.

    With ``buckets`` a table is dealt by its lookup key into so many sorted buckets: a join by that key
    then reads it in place. Otherwise it is ranged by the key, so that lookups skip files.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    before = _manifest(spark, path)
    version = 1 + max((r.version for r in before), default=0)
    rows = [(version, r.name, r.folder, r.buckets) for r in before if not (drop and r.name in tables)]
    for name, table in tables.items():
        folder = f"{path}/{name}/{version:08d}-{uuid.uuid4().hex[:8]}"
        order = TABLE_ORDER.get(name)
        if order and buckets:
            dealt = table.repartition(buckets, *order).write.bucketBy(buckets, *order).sortBy(*order)
            dealt.option("path", folder).saveAsTable(_registered(folder), format="parquet")
        elif order:
            table.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)
        else:
            table.write.parquet(folder)
        rows.append((version, name, folder, buckets if order else None))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_versions")


def _registered(folder: str) -> str:
    return f"catalogue_{hashlib.md5(folder.encode()).hexdigest()}"


def _read(spark: SparkSession, name: str, folder: str, buckets: int | None) -> DataFrame:
    if not buckets:
        return spark.read.parquet(folder)
    table, keys = _registered(folder), ", ".join(f"`{c}`" for c in TABLE_ORDER[name])
    if not spark.catalog.tableExists(table):
        # Written by another session: what the buckets are is told again.
        fields = spark.read.parquet(folder).schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{table}` ({columns}) USING parquet CLUSTERED BY ({keys})"
            f" SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(table)


def read_catalog(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The tables of the newest version. One that was added to is the union of its folders."""
    listed = _manifest(spark, path)
    found = {}
    for name in names:
        parts = [_read(spark, name, r.folder, r.buckets) for r in listed if r.name == name]
        if not parts:
            raise ValueError(f"no table {name} in {path}")
        found[name] = reduce(DataFrame.unionByName, parts)
    return found
