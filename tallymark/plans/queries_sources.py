"""Readers and writers over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.plans.catalog import query, table
from tallymark.session import fresh_path
from tallymark.sources import annotations, files, logs, manifests, receipts, sinks


def written(rows: DataFrame, key: str, order: list[str], purpose: str) -> str:
    """Text files of the column ``value``, one below the folder of each key, lines in order; their root."""
    root = fresh_path(rows.sparkSession, purpose)
    dealt = rows.repartition(sort_tasks(rows, key), key).sortWithinPartitions(key, *order)
    dealt.select(key, "value").write.partitionBy(key).text(root)
    return root


#: Rows that a task sorts, unless a key alone has more.
SORTED = 20_000


def sort_tasks(rows: DataFrame, key: str) -> int:
    """Tasks that sort the rows by key: as many as the rows need, as no fixed number of them stays
    small, and one for each key at most. Runs a job over the key."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys")).first()
    return max(1, min(told["keys"], -(-told["n"] // SORTED)))


def folder_of(path: str | Column, key: str) -> Column:
    """The key of the folder that a file lies in."""
    return F.regexp_extract(path, rf"{key}=([^/]*)/", 1)


# --- manifests --------------------------------------------------------------------------------


def manifest_files(spark, folder) -> str:
    """Items as manifest lines, some of them no records; a file holds those of 40,000 order keys."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    text = F.concat(
        F.lit('  {"id":"'), key.cast("string"), F.lit('","path":"images/'), F.repeat(F.lit("p"), 90),
        F.lit('.png","label":'), (key % 2).cast("string"), F.lit("} "),
    )
    for step, other in (
        (107, '{"id":"y"} more'), (103, '{"id":"x","label":"two"}'), (101, '["list"]'), (97, '{"id":"broken'),
        (89, "// note"), (83, ""),
    ):
        text = F.when(key % step == 0, other).otherwise(text)
    lines = table(spark, folder, "lineitem").select(
        F.expr("l_orderkey div 40000").alias("part"), "l_orderkey", "l_linenumber", text.alias("value")
    )
    return written(lines, "part", ["l_orderkey", "l_linenumber"], "manifests")


MANIFEST = """
lines AS (
  SELECT l_orderkey // 40000 AS part, l_orderkey * 8 + l_linenumber AS k,
    row_number() OVER (PARTITION BY l_orderkey // 40000 ORDER BY l_orderkey, l_linenumber) AS line FROM lineitem),
kinds AS (
  SELECT *, CASE WHEN k % 83 = 0 OR k % 89 = 0 THEN 'none' WHEN k % 97 = 0 THEN 'invalid JSON'
    WHEN k % 101 = 0 THEN 'not an object' WHEN k % 103 = 0 THEN 'wrong type'
    WHEN k % 107 = 0 THEN 'invalid JSON' ELSE 'record' END AS kind FROM lines)"""


@query(
    "manifest_bad_lines",
    f"""WITH {MANIFEST} SELECT part::VARCHAR AS part, line, kind AS reason FROM kinds
    WHERE kind NOT IN ('none', 'record')""",
)
def _(spark, folder):
    """Files of over four megabytes at sf0.01, which Spark cuts into several splits."""
    bad = manifests.bad_lines(spark, manifest_files(spark, folder), schemas.FORGERY_MANIFEST)
    return bad.select(folder_of("manifest", "part").alias("part"), "line", "reason")


@query(
    "manifest_lenient",
    f"WITH {MANIFEST} SELECT part::VARCHAR AS part, k::VARCHAR AS id, (k % 2)::INTEGER AS label FROM kinds WHERE kind = 'record'",
)
def _(spark, folder):
    rows = manifests.manifest_read(spark, manifest_files(spark, folder), schemas.FORGERY_MANIFEST, "lenient")
    return rows.select(folder_of("manifest", "part").alias("part"), "id", "label")


@query(
    "manifest_round_trip",
    """SELECT o_orderkey::VARCHAR AS id, 'orders/' || o_orderkey || '.png' AS path, (o_custkey % 2)::INTEGER AS label,
      CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS origin FROM orders""",
)
def _(spark, folder):
    """Written with a receipt and read back in strict mode."""
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, folder, "orders").select(
        key.alias("id"),
        F.concat(F.lit("orders/"), key, F.lit(".png")).alias("path"),
        (F.col("o_custkey") % 2).cast("int").alias("label"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("origin"),
    )
    path = fresh_path(spark, "manifest")
    manifests.manifest_write(rows, path)
    return manifests.manifest_read(spark, path, schemas.FORGERY_MANIFEST).select("id", "path", "label", "origin")


# --- files and digests ------------------------------------------------------------------------


def text_files(spark, folder) -> str:
    """Documents in files of 250 ids each; some folders bear names that listings pass over."""
    part = F.expr("doc_id div 250")
    name = F.concat(
        F.when(part % 4 == 1, "masks_").when(part % 4 == 2, "x_pre_holdout_").otherwise("d_"), part.cast("string")
    )
    rows = table(spark, folder, "documents").select(
        name.alias("pool"), "doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    )
    return written(rows, "pool", ["doc_id"], "files")


TEXT_FILES = """
pools AS (
  SELECT CASE doc_id // 250 % 4 WHEN 1 THEN 'masks_' WHEN 2 THEN 'x_pre_holdout_' ELSE 'd_' END || doc_id // 250 AS pool,
    string_agg(regexp_replace(text, '[\\r\\n]+', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS body
  FROM documents GROUP BY 1)"""


@query(
    "file_inventory",
    f"WITH {TEXT_FILES} SELECT pool, strlen(body) AS length, 'part' AS head FROM pools",
)
def _(spark, folder):
    listed = files.file_inventory(spark, text_files(spark, folder), suffixes=("txt",))
    return listed.select(
        folder_of(F.col("rel_path"), "pool").alias("pool"), "length", F.substring("name", 1, 4).alias("head")
    )


@query(
    "file_digests",
    f"WITH {TEXT_FILES} SELECT pool, strlen(body) AS length, sha256(body) AS sha256, md5(body) AS md5 FROM pools",
)
def _(spark, folder):
    """Read in blocks smaller than the files."""
    found = files.file_digests(spark, text_files(spark, folder), ("txt",), block=10_000)
    return found.select(folder_of(F.col("rel_path"), "pool").alias("pool"), "length", "sha256", "md5")


def catalogue(spark, folder, root: str) -> DataFrame:
    """A catalogue of digests of the files, as text: wrong for some, silent on some, with comments."""
    found = files.file_digests(spark, root).select(
        folder_of(F.col("rel_path"), "pool").alias("pool"), "md5"
    )
    number = F.regexp_extract("pool", "_([0-9]+)$", 1).cast("int")
    line = (
        F.when(number % 3 == 0, F.concat("md5", F.lit("  "), "pool"))
        .when(number % 3 == 1, F.concat(F.md5("md5"), F.lit(" *"), "pool"))
        .otherwise(F.concat(F.lit("# "), "md5", F.lit("  "), "pool"))
    )
    path = fresh_path(spark, "catalogue")
    found.select(line.alias("value")).write.text(path)
    return files.checksum_catalog_read(spark, path)


@query(
    "checksum_catalogue",
    f"""WITH {TEXT_FILES}, told AS (SELECT pool, md5(body) AS m, regexp_extract(pool, '_([0-9]+)$', 1)::INTEGER % 3 AS k FROM pools)
    SELECT pool AS name, CASE k WHEN 0 THEN m ELSE md5(m) END AS md5 FROM told WHERE k < 2""",
)
def _(spark, folder):
    return catalogue(spark, folder, text_files(spark, folder))


@query(
    "checksum_verify",
    f"""WITH {TEXT_FILES}, told AS (SELECT pool, md5(body) AS m, regexp_extract(pool, '_([0-9]+)$', 1)::INTEGER % 3 AS k FROM pools)
    SELECT pool AS name, m AS md5, CASE k WHEN 0 THEN m WHEN 1 THEN md5(m) END AS expected,
      CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'no_entry' END AS status FROM told""",
)
def _(spark, folder):
    root = text_files(spark, folder)
    digests = files.file_digests(spark, root).select(folder_of(F.col("rel_path"), "pool").alias("name"), "md5")
    return files.checksum_verify(digests, catalogue(spark, folder, root))


# --- annotations ------------------------------------------------------------------------------


@query(
    "annotation_read",
    """WITH images AS (SELECT p_partkey AS k, p_partkey // 100 AS project, p_name AS n, p_size AS s FROM part),
    entries AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY k) - 1)::INTEGER AS entry FROM images)
    SELECT project::VARCHAR AS project, entry, k || '.jpg' AS file, ordinal, name, value, width FROM (
      SELECT project, entry, k, 0 AS ordinal, 'title' AS name, n AS value, s::DOUBLE AS width FROM entries WHERE k % 5 <> 0
      UNION ALL SELECT project, entry, k, 1, 'size', s::VARCHAR, NULL FROM entries WHERE k % 5 <> 0
      UNION ALL SELECT project, entry, k, NULL, NULL, NULL, NULL FROM entries WHERE k % 5 = 0)""",
)
def _(spark, folder):
    """A project file for each hundred parts, entries in falling order of their names' letters."""
    key = F.col("p_partkey").cast("string")

    def region(field: str, value: Column, **shape: Column) -> Column:
        return F.to_json(F.struct(
            F.struct(*[v.alias(k) for k, v in shape.items()]).alias("shape_attributes"),
            F.struct(F.lit(field).alias("name"), value.alias("value")).alias("region_attributes"),
        ))

    title = region("title", F.col("p_name"), name=F.lit("rect"), width=F.col("p_size"), note=F.lit("other"))
    size = region("size", F.col("p_size"), name=F.lit("circle"), cx=F.lit(1))
    regions = F.when(F.col("p_partkey") % 5 != 0, F.concat(title, F.lit(","), size)).otherwise("")
    entry = F.concat(
        F.lit('"'), F.reverse(key), F.lit('x":{"filename":"'), key, F.lit('.jpg","size":1,"regions":['), regions, F.lit("]}")
    )
    projects = (
        table(spark, folder, "part")
        .select(F.expr("p_partkey div 100").alias("project"), "p_partkey", entry.alias("entry"))
        .groupBy("project")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "entry"))).alias("entries"))
    )
    body = F.concat(
        F.lit('{"_via_settings":{"a":[1]},"_via_img_metadata":{'), F.array_join("entries.entry", ",\n"), F.lit("}}")
    )
    root = written(projects.select("project", body.alias("value")), "project", [], "annotations")
    found = annotations.annotation_read(spark, root)
    return found.select(
        folder_of("annotation", "project").alias("project"),
        "entry",
        "file",
        "ordinal",
        F.try_element_at("attrs", F.lit("name")).alias("name"),
        F.try_element_at("attrs", F.lit("value")).alias("value"),
        F.col("shape.width").alias("width"),
    )


# --- logs and results -------------------------------------------------------------------------


def log_files(spark, folder) -> str:
    """Events as latency log lines, some without a number."""
    key = F.col("event_id")
    elapsed = (
        F.when(key % 11 == 0, "").when(key % 13 == 0, "slow").otherwise((F.col("value") * 10).cast("string"))
    )
    rows = table(spark, folder, "events").select(
        key.alias("timeStamp"),
        elapsed.alias("elapsed"),
        F.col("event_type").alias("label"),
        F.when(key % 3 == 0, "true").when(key % 3 == 1, "FALSE").alias("success"),
        F.when(key % 22 == 0, "7").alias("Latency"),
    )
    path = fresh_path(spark, "logs")
    rows.write.option("header", "true").option("emptyValue", "").csv(path)
    return path


@query(
    "latency_log",
    """SELECT event_id AS ts_ms, CASE WHEN event_id % 11 = 0 THEN 7e0 ELSE value * 10e0 END AS elapsed_ms,
      event_id % 3 = 0 AS success FROM events
    WHERE CASE WHEN event_id % 11 = 0 THEN event_id % 22 = 0 ELSE event_id % 13 <> 0 END""",
)
def _(spark, folder):
    found = logs.latency_log_read(spark, log_files(spark, folder))
    return found.withColumn("success", F.coalesce("success", F.lit(False)))


@query(
    "latency_log_rejects",
    """SELECT CASE WHEN event_id % 11 = 0 THEN 'no value' ELSE 'not a number' END AS reason,
      event_id AS line, event_type AS label FROM events
    WHERE CASE WHEN event_id % 11 = 0 THEN event_id % 22 <> 0 ELSE event_id % 13 = 0 END""",
)
def _(spark, folder):
    rejects = logs.latency_log_rejects(spark, log_files(spark, folder))
    fields = F.split("text", ",")
    return rejects.select("reason", F.get(fields, F.lit(0)).cast("bigint").alias("line"), F.get(fields, F.lit(2)).alias("label"))


def result_rows(spark, folder) -> DataFrame:
    customers = table(spark, folder, "customer")
    return customers.select(
        F.col("c_name").alias("task"),
        F.when(F.col("c_custkey") % 2 == 0, "cer_field").otherwise("tpr").alias("metric"),
        (F.col("c_acctbal") / 100.0).alias("value"),
        F.lit(0.21).alias("target"),
        (F.col("c_acctbal") < 0).alias("passed"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(True)).alias("infeasible"),
        F.col("c_nationkey").cast("bigint").alias("n"),
    )


_RESULTS = """SELECT c_name AS task, CASE WHEN c_custkey % 2 = 0 THEN 'cer_field' ELSE 'tpr' END AS metric,
  c_acctbal / 100e0 AS value, 0.21e0 AS target, c_acctbal < 0 AS passed, CASE WHEN c_custkey % 5 = 0 THEN true END AS infeasible,
  c_nationkey::BIGINT AS n FROM customer"""


@query("results_read", _RESULTS)
def _(spark, folder):
    """Results written with a receipt, items beside them, and read back."""
    path = fresh_path(spark, "results")
    rows = result_rows(spark, folder)
    sinks.result_json_write(rows, rows.select("task", "n"), path)
    return logs.results_read(spark, f"{path}/summary")


@query(
    "result_items",
    "SELECT c_name AS task, c_nationkey::BIGINT AS n FROM customer",
)
def _(spark, folder):
    path = fresh_path(spark, "results")
    rows = result_rows(spark, folder)
    sinks.result_json_write(rows, rows.select("task", "n"), path)
    return spark.read.parquet(f"{path}/items")


@query(
    "results_rejects",
    """SELECT CASE c_custkey % 4 WHEN 1 THEN '{"task":"' || c_name WHEN 2 THEN '{"task":"' || c_name || '","n":"many"}' END AS text
    FROM customer WHERE c_custkey % 4 IN (1, 2)""",
)
def _(spark, folder):
    name, kind = F.col("c_name"), F.col("c_custkey") % 4
    whole = F.concat(F.lit('{"task":"'), name, F.lit('","n":3}'))
    line = F.when(kind == 1, F.concat(F.lit('{"task":"'), name)).when(
        kind == 2, F.concat(F.lit('{"task":"'), name, F.lit('","n":"many"}'))
    ).otherwise(whole)
    path = fresh_path(spark, "results")
    table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    return logs.results_rejects(spark, path).select("text")


@query(
    "receipt_totals",
    """SELECT 'ok' AS status, count(*) AS rows, sum(strlen(c_custkey || ',/data/' || c_name) + 1)::BIGINT AS length
    FROM customer""",
)
def _(spark, folder):
    """A request list: what its receipt says, after its files were read again."""
    path = fresh_path(spark, "requests")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))
    sinks.request_csv_export(rows, path, "/data/")
    told = receipts.read_receipt(spark, path).join(receipts.verify_receipt(spark, path), "name", "full")
    head = len("id,filepath\n")
    return told.groupBy("status").agg(F.sum("rows").alias("rows"), F.sum(F.col("length") - head).alias("length"))


@query("request_csv", "SELECT c_custkey::VARCHAR AS id, '/data/' || c_name AS filepath FROM customer")
def _(spark, folder):
    path = fresh_path(spark, "requests")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))
    sinks.request_csv_export(rows, path, "/data/")
    return spark.read.option("header", "true").csv(path)
