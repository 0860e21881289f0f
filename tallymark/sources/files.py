"""File listings and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.fixedvalues import IMAGE_SUFFIXES
from tallymark.functions.documents import base_name, in_directory


def _image_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    )


def file_inventory(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
    exclude_masks: bool = True,
    exclude_holdout: bool = True,
) -> DataFrame:
    """(path, rel_path, name, length) of every image below ``root``; contents are not read."""
    files = _image_files(spark, root, suffixes).select("path", "length")
    rel = _relative(root)
    if exclude_masks:
        files = files.where(~in_directory(rel, "masks"))
    if exclude_holdout:
        files = files.where(~F.regexp_like(rel, F.lit(r"(^|/)([^/]*_pre_holdout|_holdout[^/]*)(/|$)")))
    return files.select("path", rel.alias("rel_path"), base_name(rel).alias("name"), "length")


def file_digests(
    spark: SparkSession, root: str, suffixes: Sequence[str] | None = None, block: int = 1 << 20
) -> DataFrame:
    """(rel_path, length, sha256, md5) of file contents, read in blocks of ``block`` bytes.

    Spark lists the files and deals them out by size; tasks stream each through its file system,
    so that a file may be larger than a task's memory or a binary value. Empty and hidden files
    are not listed, as in all of Spark's sources.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        if suffixes is None
        else _image_files(spark, root, suffixes)
    )
    listed = listed.select("path", _relative(root).alias("rel_path"))

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        def opened(path):
            if path.startswith("file:"):
                return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
            system, place = fs.FileSystem.from_uri(path)
            return system.open_input_stream(place)

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                sha, md5, length = hashlib.sha256(), hashlib.md5(), 0
                with opened(path) as stream:
                    while part := stream.read(block):
                        sha.update(part)
                        md5.update(part)
                        length += len(part)
                rows.append((length, sha.hexdigest(), md5.hexdigest()))
            length, sha256, md5s = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rel_path"), pa.array(length, pa.int64()), pa.array(sha256, pa.string()), pa.array(md5s, pa.string())],
                names=["rel_path", "length", "sha256", "md5"],
            )

    return listed.mapInArrow(run, "rel_path string, length bigint, sha256 string, md5 string")


def _relative(root: str):
    bare = root.rstrip("/").split("://", 1)[-1]
    if bare.startswith("file:"):
        bare = bare[len("file:") :]
    return F.element_at(F.split("path", r"\Q" + bare + r"/\E", 2), 2)


def checksum_catalog_read(spark: SparkSession, path: str) -> DataFrame:
    """``md5sum`` lines to (name, md5); comments and other lines are skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    return (
        spark.read.text(path)
        .where(~F.startswith(line, F.lit("#")) & (F.size(parts) >= 2))
        .select(
            F.ltrim(parts[1], F.lit("*")).alias("name"), F.lower(parts[0]).alias("md5")
        )
        .where(F.length("md5") == 32)
    )


def checksum_verify(digests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, md5, expected, status): ok, mismatch, or no_entry when the catalogue is silent."""
    return (
        digests.select("name", "md5")
        .join(catalog.select("name", F.col("md5").alias("expected")), "name", "left")
        .withColumn(
            "status",
            F.when(F.col("expected").isNull(), "no_entry")
            .when(F.col("expected") == F.col("md5"), "ok")
            .otherwise("mismatch"),
        )
    )
