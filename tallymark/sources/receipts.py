"""Text files written all or nothing, with a receipt of what was written.

A Python data source: tasks write their lines to a folder of the job's own and report name, rows
and digest of each file; the driver moves the files into place once every task has reported, and
writes the receipt last. A job that fails removes what its tasks left, and what stood there before
stays. Readers trust the files that the receipt names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.sources.files import file_digests

RECEIPT = "_receipt.json"
FORMAT = "lines_with_receipt"


class WrittenBefore(ValueError):
    """The path holds files of an earlier job."""


def _source():
    """The data source; defined in a function, so that workers need not have this package."""
    from pyspark.sql.datasource import (
        DataSource,
        DataSourceArrowWriter,
        DataSourceReader,
        WriterCommitMessage,
    )

    receipt = RECEIPT

    def place_of(uri):
        """(file system, path) of a path with or without a scheme."""
        from pyarrow import fs

        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].strip("/")
        if "://" not in uri:
            return fs.LocalFileSystem(), uri.rstrip("/")
        system, path = fs.FileSystem.from_uri(uri)
        return system, path.rstrip("/")

    class Written(WriterCommitMessage):
        def __init__(self, files):
            self.files = files

    class ReceiptReader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]

        def read(self, partition):
            import json

            from pyarrow import fs

            system, path = place_of(self.path)
            if system.get_file_info(f"{path}/{receipt}").type == fs.FileType.File:
                with system.open_input_stream(f"{path}/{receipt}") as told:
                    for file in json.loads(told.read())["files"]:
                        yield file["name"], file["rows"], file["length"], file["sha256"]

    class LinesWriter(DataSourceArrowWriter):
        def __init__(self, options, overwrite):
            import uuid

            self.path, self.suffix = options["path"], options.get("suffix", "txt")
            self.header, self.overwrite, self.receipt = options.get("header"), overwrite, receipt
            self.job = uuid.uuid4().hex
            system, path = self.place()
            system.create_dir(f"{path}/_job-{self.job}", recursive=True)

        def place(self):
            return place_of(self.path)

        def write(self, batches):
            import hashlib
            import uuid

            from pyspark import TaskContext

            system, path = self.place()
            part = TaskContext.get().partitionId()
            staged = f"{path}/_job-{self.job}/{uuid.uuid4().hex}"
            sha, rows, length, out = hashlib.sha256(), 0, 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                text = "".join(f"{line}\n" for line in batch.column(0).to_pylist())
                if out is None:
                    # The job's folder is the driver's: gone, it stops tasks that outlive their job.
                    out = system.open_output_stream(staged)
                    text = (f"{self.header}\n" if self.header else "") + text
                data = text.encode("utf-8")
                out.write(data)
                sha.update(data)
                rows, length = rows + batch.num_rows, length + len(data)
            if out is None:
                return Written([])
            out.close()
            name = f"part-{part:05d}.{self.suffix}"
            return Written([(staged, name, rows, length, sha.hexdigest())])

        def commit(self, messages):
            import json

            from pyarrow import fs

            system, path = self.place()
            files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
            system.create_dir(path, recursive=True)
            if self.overwrite:
                kept = {f"{path}/_job-{self.job}"}
                for info in system.get_file_info(fs.FileSelector(path)):
                    if info.path not in kept:
                        (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
            for staged, name, *_ in files:
                system.move(staged, f"{path}/{name}")
            self.clean(system, path)
            told = [{"name": n, "rows": r, "length": size, "sha256": s} for _, n, r, size, s in files]
            with system.open_output_stream(f"{path}/{self.receipt}") as out:
                out.write((json.dumps({"files": told}) + "\n").encode())

        def abort(self, messages):
            self.clean(*self.place())

        def clean(self, system, path):
            from pyarrow import fs

            own = f"{path}/_job-{self.job}"
            for _ in range(5):
                if system.get_file_info(own).type != fs.FileType.Directory:
                    break
                try:
                    system.delete_dir(own)
                except OSError:  # a task added a file meanwhile
                    continue

    class LinesWithReceipt(DataSource):
        @classmethod
        def name(cls):
            return "lines_with_receipt"

        def schema(self):
            return "name string, rows bigint, length bigint, sha256 string"

        def reader(self, schema):
            return ReceiptReader(self.options)

        def writer(self, schema, overwrite):
            return LinesWriter(self.options, overwrite)

    return LinesWithReceipt


def write_lines(
    lines: DataFrame, path: str, suffix: str = "txt", header: str | None = None, mode: str = "errorifexists"
) -> None:
    """Write the one text column of ``lines`` below ``path``, a file per task that has rows.

    ``mode`` is ``errorifexists`` or ``overwrite``, which replaces all that ``path`` holds.
    """
    spark = lines.sparkSession
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "errorifexists" and not read_receipt(spark, path).isEmpty():
        raise WrittenBefore(path)
    spark.dataSource.register(_source())
    writer = lines.select(F.col(f"`{lines.columns[0]}`").cast("string").alias("value")).write
    writer = writer.format(FORMAT).option("suffix", suffix)
    writer = writer.option("header", header) if header else writer
    writer.mode("overwrite" if mode == "overwrite" else "append").save(path)


def read_receipt(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, length, sha256) of the files written; none where there is no receipt.

    Its name begins with an underscore, as Spark's other readers are to pass over it.
    """
    spark.dataSource.register(_source())
    return spark.read.format(FORMAT).load(path)


def verify_receipt(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of the files there and in the receipt: ok, mismatch, missing or extra."""
    receipt = read_receipt(spark, path)
    found = file_digests(spark, path).select(
        F.col("rel_path").alias("name"), F.col("sha256").alias("_found")
    )
    status = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("sha256").isNull(), "extra")
        .when(F.col("sha256") == F.col("_found"), "ok")
        .otherwise("mismatch")
    )
    return receipt.join(found, "name", "full").select("name", status.alias("status"))
