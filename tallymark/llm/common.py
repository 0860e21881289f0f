"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import fresh_path, workers_know

#: ASCII lower case; every byte that is no letter, digit or part of a longer character is a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8.

    All bytes of a character beyond ASCII are 128 or more, so working on bytes cuts nowhere else.
    """
    return (text or "").encode("utf-8", "replace").translate(WORD_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def map_rows(
    df: DataFrame, columns: list[str], schema: str, work: Callable[[dict[str, list]], dict[str, list]]
) -> DataFrame:
    """Arrow batches of the columns (by position, so other columns cannot clash) through ``work``.

    A batch is worked on in slices, so that a batch of very long texts needs no second copy.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = {name: part.column(i).to_pylist() for i, name in enumerate(columns)}
                out = work(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return arrow_map(df.select(*columns), run, schema)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this repository on the workers' module path."""
    workers_know(df.sparkSession)
    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write below the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that no column of the table has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"{stem}_{uuid.uuid4().hex[:6]}"
    return stem


def lowered(column):
    """The column with A-Z, and nothing else, in lower case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
