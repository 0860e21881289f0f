"""Latency logs and metric results, and the lines of them that hold none."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.schemas import METRIC_RESULT

CORRUPT = "_corrupt"
VALUES = ("elapsed", "Latency", "elapsed_ms")


def _first_present(df: DataFrame, *names: str) -> Column:
    present = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def latency_log_parsed(spark: SparkSession, path: str) -> DataFrame:
    """(log, elapsed_ms, success, ts_ms, reason, text) of every line of CSV logs with a header.

    The value is the first filled one of elapsed, Latency and elapsed_ms. ``reason`` says why a
    line has none and is null for the others: ``no value``, ``not a number``, or ``wrong columns``
    where the line has more or fewer fields than the header. ``text`` is the line, of those only.
    """
    names = spark.read.option("header", "true").csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    log = (
        spark.read.schema(schema).option("header", "true").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    )
    value, success = _first_present(log, *VALUES), _first_present(log, "success")
    elapsed = value.try_cast("double")
    reason = (
        F.when(elapsed.isNotNull(), F.lit(None).cast("string"))
        .when(F.col(CORRUPT).isNotNull(), "wrong columns")
        .when(value.isNull(), "no value")
        .otherwise("not a number")
    )
    shown = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names])))
    return log.select(
        F.col("_metadata.file_path").alias("log"),
        elapsed.alias("elapsed_ms"),
        F.coalesce(F.lower(success).isin("true", "1", "yes"), F.lit("success" not in names)).alias("success"),
        _first_present(log, "timeStamp").try_cast("bigint").alias("ts_ms"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), shown).alias("text"),
    )


def latency_log_read(spark: SparkSession, path: str) -> DataFrame:
    """(elapsed_ms, success, ts_ms) of the lines with a value; see ``latency_log_rejects``."""
    parsed = latency_log_parsed(spark, path)
    return parsed.where(F.col("reason").isNull()).select("elapsed_ms", "success", "ts_ms")


def latency_log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(log, reason, text) of the lines without a value."""
    return latency_log_parsed(spark, path).where(F.col("reason").isNotNull()).select("log", "reason", "text")


def _results(spark: SparkSession, path: str) -> DataFrame | None:
    """(result, text, r): each line with the record parsed from it."""
    schema = T.StructType([*METRIC_RESULT.fields, T.StructField(CORRUPT, T.StringType())])
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("result"), F.col("value").alias("text"), parsed.alias("r")
    )


def results_read(spark: SparkSession, path: str) -> DataFrame | None:
    """Metric results, or None when there are none yet; see ``results_rejects``."""
    found = _results(spark, path)
    return None if found is None else found.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def results_rejects(spark: SparkSession, path: str) -> DataFrame | None:
    """(result, text) of the lines that are no metric result."""
    found = _results(spark, path)
    return None if found is None else found.where(F.col(f"r.{CORRUPT}").isNotNull()).select("result", "text")
