"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of ascending ids. An index holds the keys of all lines seen so far as
runs: tables of (hash, least document) bucketed and sorted by the hash, no key in two runs. A new
batch is reduced to one row per key, merge-joined with each run without shuffling the runs, and what
no run holds becomes a run of level 0. Once a level has ``fanout`` runs they are compacted into one
run of the next level, so that a batch meets few runs however many came before.

A line is dropped where its key belongs to a document of a smaller id. A key that a third of the
documents share is one row after map-side aggregation; marking its lines takes the broadcast path
of the hot split join. Hashes are 128 bits long.

Defined cases: a null or empty text is one empty line; a text of any length is split whole. Rows
without an id take no part and keep all lines. Rows that share an id are one document in several
texts: lines are dropped from each text by its own places, and none because another of them holds
it. Ids may be of any type with an order. Ties cannot arise, as one key has one least id. Extra
columns may bear any name. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallymark.llm.common import arrow_map, lowered, map_rows, store, unused
from tallymark.operators.joins import hot_split_join
from tallymark.session import fresh_path, shuffle_width

BLANKS = " \t\n\x0b\f\r"


class LineRuns:
    """The index: runs by level, each a table below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout = spark, fanout
        self.width = shuffle_width(spark)
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def earlier(self, keys: DataFrame) -> DataFrame:
        """``keys`` (hash, ...) with ``earlier``: the document that holds the key in a run, or null."""
        found = keys.withColumn("earlier", F.lit(None).cast(keys.schema["first"].dataType))
        for run in self.runs():
            run = run.withColumnRenamed("first", "held")
            found = (
                found.join(run.hint("merge"), "hash", "left")
                .withColumn("earlier", F.coalesce("earlier", "held"))
                .drop("held")
            )
        return found

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Add (hash, first), of keys that no run holds, as a run; compact full levels."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.width, "hash")
            .write.bucketBy(self.width, "hash")
            .sortBy("hash")
            .option("path", fresh_path(self.spark, "line-run"))
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self.add(merged, level + 1)
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")

    def forget(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, mark, at, hash) of every line whose key has ``least`` code points or more.

    ``mark`` tells the texts of one id apart.
    """
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("mark"),
        F.posexplode_outer(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "line"),
    )
    key = lowered(F.trim("line", F.lit(BLANKS)))
    return lines.where(F.length(key) >= least).select("id", "mark", "at", F.unhex(F.md5(key)).alias("hash"))


def batch_cuts(docs: DataFrame, id_col: str, batches: int, looked_at: int = 1000) -> list:
    """Ids that cut the documents into batches of about the same size."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    if isinstance(docs.schema[id_col].dataType, NumericType):
        cuts = docs.select(F.percentile_approx(id_col, shares, 10000)).first()[0]
        return cuts or []
    # Ids that are no numbers: by the order of those with the least hashes. Any cuts do.
    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"))
    found = sorted(r.id for r in some.limit(looked_at).collect())
    return [found[int(share * len(found))] for share in shares] if found else []


def dropped_lines(
    docs: DataFrame, id_col: str, text_col: str, batches: int, fanout: int, least: int
) -> DataFrame:
    """(id, mark, at): the lines to drop, one batch of ids after the other."""
    spark = docs.sparkSession
    keys = line_keys(docs, id_col, text_col, least)
    cuts = batch_cuts(docs, id_col, batches)
    batch = sum(((F.col("id") > F.lit(cut)).cast("int") for cut in cuts), F.lit(0))
    path = fresh_path(spark, "line-keys")
    keys.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    kind = docs.schema[id_col].dataType.simpleString()
    lines = spark.read.schema(f"id {kind}, mark long, at int, hash binary, batch int").parquet(path)
    index, drops = LineRuns(spark, fanout), []
    try:
        for number in range(batches):
            arriving = lines.where(F.col("batch") == number).drop("batch")
            one_row = arriving.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n"))
            known = store(index.earlier(one_row), "line-known")
            index.add(known.where("earlier IS NULL").select("hash", "first"))
            decisive = known.where("earlier IS NOT NULL OR n > 1").select(
                "hash", "n", F.coalesce("earlier", "first").alias("first")
            )
            drops.append(
                store(
                    hot_split_join(arriving, decisive, ["hash"], "n")
                    .where("id > first")
                    .select("id", "mark", "at"),
                    "line-drops",
                )
            )
    finally:
        index.forget()
    out = drops[0]
    for other in drops[1:]:
        out = out.unionByName(other)
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 4,
    fanout: int = 2,
    least: int = 10,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept): every document with the text that stays.

    A key is a line without blanks at both ends, A-Z lowered. Keys of ``least`` code points or more
    stay only in the document of the smallest id that holds them, with all their lines there.
    """
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = _with_drops(narrow, "key", "text", batches, fanout, least, "gone")

    def work(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {id_col: part["key"], "n_lines": [], "n_dropped": [], "kept": []}
        for text, gone in zip(part["text"], part["gone"]):
            lines, kept = kept_lines(text, gone)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept"].append("\n".join(kept))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_lines long, n_dropped long, kept string"
    return map_rows(rows, ["key", "text", "gone"], schema, work)


def without_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
    batches: int = 4,
    fanout: int = 2,
    least: int = 10,
) -> DataFrame:
    """The documents, all columns, without the lines to drop; ``length_col`` follows the text."""
    gone = unused(docs, "gone")
    rows = _with_drops(docs, id_col, text_col, batches, fanout, least, gone)
    at, size = docs.columns.index(text_col), None
    if length_col in docs.columns:
        size = docs.columns.index(length_col)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, absent = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1)
            for i, lines in enumerate(absent.to_pylist()):
                if lines:
                    texts[i] = "\n".join(kept_lines(texts[i], lines)[1])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                lengths = [n if t is None else len(t) for n, t in zip(columns[size].to_pylist(), texts)]
                columns[size] = pa.array(lengths, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return arrow_map(rows, run, docs.schema)


def kept_lines(text: str | None, gone: list[int] | None) -> tuple[list[str], list[str]]:
    """(all lines, lines that stay) of a text."""
    lines = (text or "").split("\n")
    absent = set(gone or ())
    return lines, [x for i, x in enumerate(lines) if i not in absent]


def _with_drops(
    docs: DataFrame, id_col: str, text_col: str, batches: int, fanout: int, least: int, gone: str
) -> DataFrame:
    """The documents, all columns, and last the places of the lines to drop."""
    drops = dropped_lines(docs, id_col, text_col, batches, fanout, least)
    key, mark = unused(docs, "key"), unused(docs, "mark")
    places = drops.distinct().groupBy(F.col("id").alias(key), F.col("mark").alias(mark))
    by_text = places.agg(F.collect_list("at").alias(gone))
    rows = docs.withColumns({key: F.col(id_col), mark: F.xxhash64(text_col)})
    return rows.join(by_text, [key, mark], "left").select(*docs.columns, gone)


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
