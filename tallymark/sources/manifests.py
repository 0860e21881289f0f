"""JSON-lines manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.rows import bind
from tallymark.sources.lines import numbered_lines
from tallymark.sources.receipts import write_lines

CORRUPT = "_corrupt_line"


class ManifestError(ValueError):
    """A manifest line that is not valid JSON."""


def _stripped() -> Column:
    return F.regexp_replace("value", r"^\s+|\s+$", "")


def _is_record(line: Column) -> Column:
    """Neither blank nor a comment."""
    return (line != "") & ~F.startswith(line, F.lit("//"))


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank, non-comment lines with the file they come from; a missing path raises."""
    return (
        spark.read.text(path)
        .select(_stripped().alias("line"), F.col("_metadata.file_path").alias("manifest"))
        .where(_is_record(F.col("line")))
    )


def _parsed(line: Column, schema: T.StructType) -> Column:
    """STRUCT(v, corrupt): the record of a line, or the line itself where it is none.

    The parser ignores what follows a value. Inside braces and inside brackets a record with
    anything after it is no single value in one of them, whatever follows.
    """
    wide = T.StructType([T.StructField("v", schema), T.StructField(CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    inside = F.from_json(F.concat(F.lit('{"v":'), line, F.lit("}")), wide, options)
    alone = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1

    def checked(found: Column) -> Column:
        good = found["v"].isNotNull() & found[CORRUPT].isNull() & F.coalesce(alone, F.lit(False))
        return F.struct(F.when(good, found["v"]).alias("v"), F.when(~good, line).alias(CORRUPT))

    return bind(inside, checked)


def manifest_parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed rows plus the raw text of lines that did not parse."""
    rows = manifest_lines(spark, path).select("manifest", _parsed(F.col("line"), schema).alias("r"))
    return rows.select("manifest", "r.v.*", f"r.{CORRUPT}")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(manifest, line, reason, text) of the lines that are no record of the schema.

    ``line`` is the line's number in its file, blank lines and comments counted. ``reason`` is
    ``invalid JSON`` (NaN and text after the record included), ``not an object``, or ``wrong
    type`` where a known field holds another type.
    """
    text = _stripped()
    broken = _is_record(text) & _parsed(text, schema)[CORRUPT].isNotNull()
    found = numbered_lines(spark, path, broken).select(
        F.col("file").alias("manifest"), "line", text.alias("text")
    )
    anything = T.StructType([T.StructField("v", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    # As text every value has the right type, so that only broken JSON is corrupt.
    options = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    valid = F.from_json(F.concat(F.lit('{"v":'), F.col("text"), F.lit("}")), anything, options)
    alone = F.json_array_length(F.concat(F.lit("["), F.col("text"), F.lit("]"))) == 1
    reason = (
        F.when(valid[CORRUPT].isNotNull() | ~F.coalesce(alone, F.lit(False)), "invalid JSON")
        .when(~F.startswith("text", F.lit("{")), "not an object")
        .otherwise("wrong type")
    )
    return found.select("manifest", "line", reason.alias("reason"), "text")


def manifest_read(
    spark: SparkSession, path: str, schema: T.StructType, mode: str = "strict", shown: int = 5
) -> DataFrame:
    """Read a manifest. ``strict`` runs a job and raises on bad lines, ``lenient`` drops them."""
    parsed = manifest_parsed(spark, path, schema)
    if mode == "lenient":
        return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    bad = bad_lines(spark, path, schema).orderBy("manifest", "line").limit(shown).collect()
    if bad:
        listed = "\n  ".join(f"{row.manifest}:{row.line}: {row.reason}: {row.text}" for row in bad)
        raise ManifestError(f"unreadable lines:\n  {listed}")
    return parsed.drop(CORRUPT)


def manifest_write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with a receipt; a failed job leaves what was there before."""
    write_lines(df.select(F.to_json(F.struct("*")).alias("line")), path, "jsonl", mode=mode)
