"""Sweep tables, metric payloads and request lists on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.sources.receipts import write_lines


def sweep_csv_rows(sweep: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return sweep.select(
        *keep,
        F.format_string("%.2f", "threshold").alias("threshold"),
        # Ties round to even first; the formatter alone would round them up.
        *[F.format_string("%.6f", F.bround(F.col(m), 6)).alias(m) for m in metrics],
    )


def sweep_csv_write(
    sweep: DataFrame, path: str, metrics: Sequence[str], keep: Sequence[str] = ()
) -> None:
    """One CSV per sweep: at most 101 rows per group, in threshold order."""
    (
        sweep_csv_rows(sweep, metrics, keep)
        .orderBy(*keep, "threshold")
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", "true")
        .csv(path)
    )


def result_json_write(
    summary: DataFrame, items: DataFrame | None, path: str, mode: str = "overwrite"
) -> None:
    """Metric payload as JSON lines with a receipt; per-item rows beside it as Parquet."""
    write_lines(summary.select(F.to_json(F.struct("*")).alias("line")), f"{path}/summary", "json", mode=mode)
    if items is not None:
        items.write.mode(mode).parquet(f"{path}/items")


def request_csv_export(manifest: DataFrame, path: str, root: str, mode: str = "overwrite") -> None:
    """(id, filepath) list for a load generator, as CSV files with a header and a receipt."""
    target = F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("filepath")
    lines = manifest.select("id", target).select(F.to_csv(F.struct("id", "filepath")).alias("line"))
    write_lines(lines, path, "csv", header="id,filepath", mode=mode)
