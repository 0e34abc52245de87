"""JSON-lines files in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gavel.functions.text import JSON_LIMITS, empty_if_null, is_blank, lenient_int
from gavel.operators.rejects import split_rejects
from gavel.session import materialized

_CORRUPT = "_corrupt_record"
BLANK, BROKEN = "blank line", "invalid JSON"


@dataclass(frozen=True)
class RecordSchema:
    """Fields of a record file, as a type or as DDL; lenient fields are declared STRING."""

    fields: T.StructType | str
    lenient_ints: Sequence[str] = ()
    lenient_texts: Sequence[str] = ()

    def struct(self) -> T.StructType:
        # DDL needs a running session, so it is parsed on use.
        return T.StructType.fromDDL(self.fields) if isinstance(self.fields, str) else self.fields


def text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of all paths with ``seq``, a total order: caller's path order, file, split, line.

    Files are packed into tasks by size, so the row id alone is not the input order; within
    one split it is. Empty lines are kept.
    """

    def one(rank: int, path: str) -> DataFrame:
        return spark.read.text(path).select(
            F.struct(
                F.lit(rank).alias("path_rank"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("seq"),
            F.lit(path).alias("path"),
            F.col("value").alias("line"),
        )

    return reduce(DataFrame.unionByName, [one(rank, path) for rank, path in enumerate(paths)])


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, the physical 1-based line in its file.

    One extra pass, run at once, counts the lines of each split. Row ids are contiguous inside
    a split, so the number is the id's distance from the split's first id plus the lines of
    earlier splits: one huge file is as parallel as many small ones. The table of splits is
    written, so Spark knows its size and decides how to join it.
    """
    part = ["path_rank", "file", "block"]
    counted = (
        lines.select("seq.*")
        .groupBy(*part)
        .agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    )
    before = (
        Window.partitionBy("path_rank", "file")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = counted.select(
        F.struct(*part).alias("_split"),
        "first_row",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("lines_before"),
    )
    splits = materialized(splits)
    placed = lines.withColumn("_split", F.struct(*[F.col(f"seq.{c}") for c in part]))
    joined = placed.join(splits, "_split", "left")
    number = F.col("seq.row") - F.col("first_row") + F.col("lines_before") + 1
    # A split unknown to the counting pass would mean the files changed in between.
    checked = F.coalesce(number, F.raise_error(F.lit("input changed while it was read")).cast("bigint"))
    return joined.withColumn("line_no", checked).drop("_split", "first_row", "lines_before")


def scan_jsonl(
    spark: SparkSession, paths: Sequence[str], schema: RecordSchema, line_numbers: bool = False
) -> DataFrame:
    """Every line with its parsed ``record`` and a ``reason`` (NULL for a good record)."""
    lines = text_lines(spark, paths)
    if line_numbers:
        lines = with_line_numbers(lines)
    return parse_lines(lines, schema)


def parse_lines(lines: DataFrame, schema: RecordSchema) -> DataFrame:
    """Parse a ``line`` column into ``record`` and ``reason``; works on streams too."""
    fields = schema.struct()
    with_corrupt = T.StructType([*fields.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json("line", with_corrupt, {**JSON_LIMITS, "columnNameOfCorruptRecord": _CORRUPT})
    # The one-element explode keeps later filters from being pushed below it, where they would
    # parse every line again; outer, as an inner one gets a filter of its own.
    once = F.array(F.when(~is_blank(F.col("line")), parsed))
    df = lines.select("*", F.explode_outer(once).alias("_raw"))

    reason = F.when(F.col("_raw").isNull(), BLANK).when(
        F.col(f"_raw.{_CORRUPT}").isNotNull(), BROKEN
    )
    columns = []
    for field in fields.fieldNames():
        value = F.col("_raw").getField(field)
        if field in schema.lenient_ints:
            number = lenient_int(value)
            reason = reason.when(number.isNull(), f"field {field} is not an integer")
            value = number
        elif field in schema.lenient_texts:
            value = empty_if_null(value)
        columns.append(value.alias(field))
    return df.withColumn("reason", reason).withColumn("record", F.struct(*columns)).drop("_raw")


def read_jsonl(
    spark: SparkSession,
    paths: Sequence[str],
    schema: RecordSchema,
    on_error: str = "split",
    line_numbers: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: blank lines skipped, broken lines reported with their path."""
    return rows_and_rejects(scan_jsonl(spark, paths, schema, line_numbers), on_error)


def rows_and_rejects(scanned: DataFrame, on_error: str = "split") -> tuple[DataFrame, DataFrame]:
    """Part a scan into records and rejects, leaving blank lines out."""
    kept = scanned.filter(F.col("reason").isNull() | (F.col("reason") != BLANK))
    good, bad = split_rejects(kept, F.col("reason"), on_error)
    position = [c for c in ("seq", "path", "line_no") if c in scanned.columns]
    return (
        good.select(*position, "record.*"),
        bad.select(*position, "line", "reason"),
    )


def import_summary(scanned: DataFrame, skipped: Column) -> DataFrame:
    """Line counts per path plus one total row (NULL path), in one aggregation.

    ``scanned`` comes from :func:`scan_jsonl`; ``skipped`` marks good records without a key.
    """
    good = F.col("reason").isNull()
    skip = good & F.coalesce(skipped, F.lit(False))
    blank = F.coalesce(F.col("reason") == BLANK, F.lit(False))
    return scanned.rollup("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(blank).alias("blank"),
        F.count_if(skip).alias("skipped"),
        F.count_if(good & ~skip).alias("loaded"),
        F.count_if(~good & ~blank).alias("rejected"),
    )


def write_jsonl(data: DataFrame | Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """Write one frame, or all splits one after another, as JSON lines.

    Nulls are kept and text outside ASCII is escaped. No split column is added.
    """
    if isinstance(data, Mapping):
        data = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), list(data.values())
        )
    data.write.mode(mode).options(
        ignoreNullFields="false", writeNonAsciiCharacterAsCodePoint="true"
    ).json(path)
