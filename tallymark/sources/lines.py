"""Text files by line number, however many splits a file is cut into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.joins import null_safe_join


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, value) per line: the split's offset, and a number that rises by one within it.

    A split is read in order by one task, so that ``seq`` less the split's least is the place of a
    line in its split. It must stand right above the scan, before any filter.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def split_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, first_seq, lines_before, lines): one row per split, from the counts of lines."""
    counted = _scan(spark, path).groupBy("file", "split").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("lines")
    )
    # A file's splits, not its lines, stand in order here: a few thousand rows for a terabyte.
    earlier = F.expr("sum(lines) OVER (PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return counted.withColumn("lines_before", F.coalesce(earlier, F.lit(0)))


def numbered_lines(
    spark: SparkSession, path: str, keep: Column | None = None
) -> DataFrame:
    """(file, line, value) of the lines of text files that ``keep`` (over ``value``) holds for.

    Lines count from 1, blank ones too, and end as in universal newlines. Tasks count the lines of
    their splits, the counts are summed along each file, and each line is moved by the sum before
    its split: files are read twice and no line is shuffled unless there are too many splits to
    broadcast. A missing path raises.
    """
    rows = _scan(spark, path)
    if keep is not None:
        rows = rows.where(keep)
    placed = null_safe_join(
        rows, split_offsets(spark, path).select("file", "split", "first_seq", "lines_before"), ["file", "split"]
    )
    line = F.col("lines_before") + F.col("seq") - F.col("first_seq") + 1
    return placed.select("file", line.cast("bigint").alias("line"), "value")
