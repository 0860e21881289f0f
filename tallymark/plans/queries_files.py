"""Latency, histograms, ablations, annotations, raw OCR results, scorers and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import annotations, provenance, reporting, scoring, sweep, validation
from tallymark.operators.pairing import scored_pair_sweep
from tallymark.plans import evaluations
from tallymark.plans.catalog import query, table
from tallymark.plans.queries_pairs import PAIRS, pair_sweep_sql, pairs
from tallymark.plans.queries_people import RESOLVED, handle_rows, persons
from tallymark.plans.queries_records import FIELDS, items, parts
from tallymark.plans.queries_scores import SCORES, maximin_sql, scores, sweep_sql
from tallymark.session import materialize
from tallymark.sources.annotations import annotation_entries, explode_regions


def latency(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_type",
        (F.col("value") * 10.0).alias("elapsed_ms"),
        (F.col("event_type") != "error").alias("success"),
        "ts",
    )


_LATENCY = """count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS successes,
  count(*) FILTER (WHERE event_type = 'error') AS failures,
  round(avg(value * 10e0 / 1000e0), 6) AS mean_seconds"""


@query(
    "latency_summary",
    f"SELECT {_LATENCY}, avg(value * 10e0 / 1000e0) < 60 AS passed FROM events",
)
def _(spark, folder):
    out = reporting.latency_summary(latency(spark, folder))
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6)).drop("p50_seconds", "p95_seconds")


@query(
    "latency_by_type",
    f"SELECT event_type, {_LATENCY}, avg(value * 10e0 / 1000e0) < 0.2e0 AS passed FROM events GROUP BY event_type",
)
def _(spark, folder):
    out = reporting.latency_summary(latency(spark, folder), 0.2, ["event_type"])
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6)).drop("p50_seconds", "p95_seconds")


@query(
    "latency_percentiles",
    """WITH s AS (SELECT event_type, value * 10e0 / 1000e0 AS x FROM events),
    cuts AS (SELECT *, x <= quantile_disc(x, 0.505) OVER w AND x >= quantile_disc(x, 0.495) OVER w AS near50,
        x <= quantile_disc(x, 0.955) OVER w AND x >= quantile_disc(x, 0.945) OVER w AS near95
      FROM s WINDOW w AS (PARTITION BY event_type))
    SELECT event_type, count(*) AS n, bool_or(near50) AS p50_in_error, bool_or(near95) AS p95_in_error FROM cuts GROUP BY event_type""",
)
def _(spark, folder):
    """Sketches kept for each day and merged by type; their percentiles against the exact ranks."""
    log = latency(spark, folder).withColumn("day", F.to_date("ts"))
    kept = materialize(reporting.latency_sketches(log, ["event_type", "day"]))
    merged = reporting.merged_latency(kept, keys=["event_type"])
    seconds = F.col("elapsed_ms") / 1000.0
    ranked = log.join(merged.select("event_type", "n", "p50_seconds", "p95_seconds"), "event_type").groupBy("event_type").agg(
        F.first("n").alias("n"),
        *[
            agg.alias(f"{side}{p}")
            for p in ("50", "95")
            for side, agg in (
                ("below", F.count_if(seconds < F.col(f"p{p}_seconds"))),
                ("upto", F.count_if(seconds <= F.col(f"p{p}_seconds"))),
            )
        ],
    )
    error = reporting.SKETCH_ERROR
    return ranked.select(
        "event_type",
        "n",
        *[
            ((F.col(f"below{p}") <= (q + error) * F.col("n")) & (F.col(f"upto{p}") >= (q - error) * F.col("n"))).alias(f"p{p}_in_error")
            for p, q in (("50", 0.5), ("95", 0.95))
        ],
    )


def histogram_sql(values: str, bins: str) -> str:
    return f"""WITH v AS ({values}),
    stats AS (SELECT min(x) AS lo, max(x) AS hi, {bins} AS bins FROM v),
    edges AS (SELECT b AS bin, lo + b * ((hi - lo) / bins::DOUBLE) AS lo,
        CASE WHEN b + 1 = bins THEN hi ELSE lo + (b + 1) * ((hi - lo) / bins::DOUBLE) END AS hi, b + 1 = bins AS last
      FROM (SELECT *, unnest(range(bins)) AS b FROM stats))
    SELECT bin, edges.lo, edges.hi, count(x) AS n FROM edges
    LEFT JOIN v ON x >= edges.lo AND (x < edges.hi OR (last AND x <= edges.hi)) GROUP BY ALL"""


@query(
    "score_histogram",
    histogram_sql(
        "SELECT o_totalprice / 500000e0 AS x FROM orders", "least(20, greatest(5, count(*)))::BIGINT"
    ),
)
def _(spark, folder):
    return reporting.score_histogram(scores(spark, folder), "score")


@query(
    "latency_histogram",
    histogram_sql(
        "SELECT value * 10e0 / 1000e0 AS x FROM events",
        "least(30, greatest(8, floor(sqrt(count(*)))))::BIGINT",
    ),
)
def _(spark, folder):
    seconds = latency(spark, folder).withColumn("seconds", F.col("elapsed_ms") / 1000.0)
    return reporting.score_histogram(seconds, "seconds", reporting.LATENCY_BINS, root=True)


def ablations(spark, folder) -> DataFrame:
    """Orders as ablation rows: the priority names the configuration, some rows lack a value."""
    names = {"1-URGENT": "none", "2-HIGH": "deskew", "3-MEDIUM": "perspective", "5-LOW": "all"}
    named = F.lit("bg_remove")
    for priority, name in names.items():
        named = F.when(F.col("o_orderpriority") == priority, name).otherwise(named)
    value = F.col("o_totalprice") / 500000.0
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        named.alias("ablation"),
        F.when(F.col("o_custkey") % 9 != 0, value).alias("cer"),
        F.when(F.col("o_custkey") % 5 != 0, value * 300.0).alias("latency_ms"),
    )


ABLATIONS = """
ablated AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'none' WHEN '2-HIGH' THEN 'deskew'
      WHEN '3-MEDIUM' THEN 'perspective' WHEN '5-LOW' THEN 'all' ELSE 'bg_remove' END AS ablation,
    CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice / 500000e0 END AS cer,
    CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / 500000e0 * 300e0 ELSE 0e0 END AS latency_ms FROM orders),
summary AS (
  SELECT ablation, round(avg(cer), 6) AS cer_field, count(*) AS n, count(cer) AS n_with_gt_fields,
    round(avg(latency_ms), 6) AS mean_latency_ms FROM ablated GROUP BY ablation)"""


@query("ablation_summary", f"WITH {ABLATIONS} SELECT * FROM summary")
def ablation_summary(spark, folder):
    out = reporting.ablation_summary(ablations(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("cer_field", "mean_latency_ms")})


@query(
    "ablation_vs_baseline",
    f"""WITH {ABLATIONS}, base AS (SELECT cer_field AS b FROM summary WHERE ablation = 'none')
    SELECT ablation, cer_field, b AS baseline_cer_field,
      CASE WHEN cer_field < b - 1e-6 THEN 'keep' ELSE 'drop' END AS decision
    FROM summary, base WHERE ablation <> 'none'""",
)
def _(spark, folder):
    return reporting.ablation_vs_baseline(ablation_summary(spark, folder))


@query(
    "backend_comparison",
    """WITH b AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'classic' WHEN 'O' THEN 'layout' ELSE 'active' END
        AS backend, round(avg(o_totalprice / 500000e0), 6) AS v FROM orders GROUP BY 1)
    SELECT 'cer_field' AS metric, max(v) FILTER (WHERE backend = 'active') AS active,
      max(v) FILTER (WHERE backend = 'classic') AS classic, max(v) FILTER (WHERE backend = 'layout') AS layout,
      max(v) FILTER (WHERE backend = 'absent') AS absent FROM b""",
)
def _(spark, folder):
    name = F.when(F.col("domain") == "F", "classic").when(F.col("domain") == "O", "layout").otherwise("active")
    results = scores(spark, folder).groupBy(name.alias("backend")).agg(
        F.round(F.avg("score"), 6).alias("cer_field")
    )
    return reporting.backend_comparison(
        results.withColumn("metric", F.lit("cer_field")), ["active", "classic", "layout", "absent"]
    )


@query(
    "gate_summary",
    f"""WITH {FIELDS}, cer AS (SELECT avg(cer_field) AS v FROM items),
    {SCORES}, one AS (SELECT 1 AS g, score, label FROM fx_scores), {sweep_sql('one', 'g')}, {maximin_sql('g')},
    lat AS (SELECT avg(value * 10e0 / 1000e0) AS v FROM events),
    faces AS (
      SELECT s.tpr AS sensitivity, s.accuracy, row_number() OVER (ORDER BY
        least((s.tpr - 0.84e0) / 0.84e0, (s.accuracy - 0.8e0) / 0.8e0) DESC, least(s.tpr, s.accuracy) DESC, s.threshold) AS place
      FROM swept s WHERE s.tpr >= 0.84e0 AND s.accuracy >= 0.8e0),
    face AS (SELECT max(sensitivity) AS sensitivity, max(accuracy) AS accuracy, count(*) = 0 AS infeasible
      FROM faces WHERE place = 1),
    lines AS (
      SELECT 1 AS position, 'cer' AS metric, 0.21e0 AS target, v AS value,
             CASE WHEN v < 0.21e0 THEN 'PASS' ELSE 'FAIL' END AS status FROM cer
      UNION ALL SELECT 2, 'tpr', 0.88e0, tpr, CASE WHEN infeasible THEN 'FAIL' ELSE 'PASS' END FROM operating
      UNION ALL SELECT 3, 'f1', 0.79e0, f1, CASE WHEN infeasible THEN 'FAIL' ELSE 'PASS' END FROM operating
      UNION ALL SELECT 4, 'sensitivity', 0.84e0, sensitivity, CASE WHEN infeasible THEN 'FAIL' ELSE 'PASS' END FROM face
      UNION ALL SELECT 5, 'accuracy', 0.8e0, accuracy, CASE WHEN infeasible THEN 'FAIL' ELSE 'PASS' END FROM face
      UNION ALL SELECT 6, 'seconds', 60e0, v, CASE WHEN v < 60 THEN 'PASS' ELSE 'FAIL' END FROM lat)
    SELECT position, metric, target, round(value, 6) AS value, status FROM lines""",
)
def _(spark, folder):
    rows = scores(spark, folder)
    swept = sweep.threshold_sweep(rows)
    # The same scores as similarities of pairs, judged on sensitivity and accuracy.
    as_pairs = rows.select(
        F.when(F.col("id").isNotNull(), "only").alias("backend"), (F.col("label") == 1).alias("same"), F.col("score").alias("similarity")
    )
    out = reporting.gate_summary(
        spark,
        cer=items(spark, folder).agg(F.avg("cer_field").alias("cer_field")),
        forgery=sweep.maximin_threshold(swept, sweep.FORGERY_TARGETS),
        faces=scored_pair_sweep(as_pairs),
        latency=reporting.latency_summary(latency(spark, folder)),
    )
    return out.withColumn("value", F.round("value", 6))


# --- raw OCR results and annotations ----------------------------------------------------------

_RAW_BLOCKS = (
    '{"res":{"parsing_res_list":[{"block_label":"title","block_content":" %n ","block_bbox":[1,2,%s,40],'
    '"score":0.5},{"label":"ocr","content":"%n","score":0.25}]}}',
    '{"boxes":[{"type":"table","text":"%n","coordinate":[[0,%s],[9,1],[4,50]]},{"label":"figure","content":"%n"}]}',
    '{"layout_det_res":{"boxes":[{"content":"  ","bbox":[%s,2,3,4],"confidence":0.75}]}}',
    '[{"label":"text","block_content":"%n","bbox":[]},{"content":"%n","box":[%s,7]}]',
)


@query(
    "ocr_blocks",
    """WITH p AS (SELECT p_partkey AS id, p_name AS n, p_size AS s, p_partkey % 4 AS k FROM part)
    SELECT id, 0 AS idx, 'title_000' AS name, n AS value, concat_ws(',', 1, 2, s, 40) AS bbox, 0.5e0 AS confidence
      FROM p WHERE k = 0
    UNION ALL SELECT id, 1, 'ocr_001', n, '0,0,1,1', 0.25e0 FROM p WHERE k = 0
    UNION ALL SELECT id, 0, 'table_000', n, concat_ws(',', 0, least(s, 1), 9, greatest(s, 50)), NULL FROM p WHERE k = 1
    UNION ALL SELECT id, 1, 'figure_001', NULL, NULL, NULL FROM p WHERE k = 1
    UNION ALL SELECT id, 0, 'block_000', NULL, concat_ws(',', s, 2, 3, 4), 0.75e0 FROM p WHERE k = 2
    UNION ALL SELECT id, 0, 'text_000', n, '0,0,1,1', NULL FROM p WHERE k = 3
    UNION ALL SELECT id, 1, 'block_001', n, '0,0,1,1', NULL FROM p WHERE k = 3""",
)
def _(spark, folder):
    raw = F.get(F.array(*[F.lit(r) for r in _RAW_BLOCKS]), (F.col("p_partkey") % 4).cast("int"))
    filled = F.replace(F.replace(raw, F.lit("%n"), F.col("p_name")), F.lit("%s"), F.col("p_size").cast("string"))
    results = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), filled.alias("raw"))
    return _shown_boxes(annotations.ocr_block_normalize(results))


_RAW_LINES = (
    '{"res":{"rec_texts":["%n","b"],"rec_scores":[0.5],"rec_polys":[[[1,2],[%s,40]],[[0,0],[1,1]]]}}',
    '[{"text":"%n","score":0.25,"points":[[3,4],[%s,1]]},{"rec_text":"%n"}]',
    '[[[[1,1],[%s,2],[3,60]],["%n",0.75]],[[[5,6],[7,8]],["c",1.0]]]',
    '[[[[[1,1],[%s,2],[3,60]],["%n",0.75]]]]',
)


@query(
    "ocr_lines",
    """WITH p AS (SELECT p_partkey AS id, p_name AS n, p_size AS s, p_partkey % 4 AS k FROM part)
    SELECT id, 0 AS idx, 'line_000' AS name, n AS value, concat_ws(',', least(1, s), 2, greatest(1, s), 40) AS bbox,
      0.5e0 AS confidence FROM p WHERE k = 0
    UNION ALL SELECT id, 1, 'line_001', 'b', '0,0,1,1', NULL FROM p WHERE k = 0
    UNION ALL SELECT id, 0, 'line_000', n, concat_ws(',', least(3, s), 1, greatest(3, s), 4), 0.25e0 FROM p WHERE k = 1
    UNION ALL SELECT id, 1, 'line_001', NULL, NULL, NULL FROM p WHERE k = 1
    UNION ALL SELECT id, 0, 'line_000', n, concat_ws(',', 1, 1, greatest(3, s), 60), 0.75e0 FROM p WHERE k IN (2, 3)
    UNION ALL SELECT id, 1, 'line_001', 'c', '5,6,7,8', 1e0 FROM p WHERE k = 2""",
)
def _(spark, folder):
    raw = F.get(F.array(*[F.lit(r) for r in _RAW_LINES]), (F.col("p_partkey") % 4).cast("int"))
    filled = F.replace(F.replace(raw, F.lit("%n"), F.col("p_name")), F.lit("%s"), F.col("p_size").cast("string"))
    results = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), filled.alias("raw"))
    return _shown_boxes(annotations.ocr_line_normalize(results))


def _shown_boxes(blocks: DataFrame) -> DataFrame:
    whole = F.transform("bbox", lambda v: v.cast("int").cast("string"))
    return blocks.withColumn("bbox", F.when(F.col("bbox").isNotNull(), F.array_join(whole, ",")))


_PROJECT = (
    '{"_via_img_metadata":{"a":{"filename":"%c/%i.jpg","regions":['
    '{"shape_attributes":{"name":"rect","x":1,"y":2,"width":%s,"height":4},"region_attributes":{"field_name":"name","value":"%n"}},'
    '{"shape_attributes":{"name":"rect"},"region_attributes":{"name":"brand","value":"","field_value":"old"}},'
    '{"shape_attributes":{"name":"polygon","all_points_x":[1,%s,3],"all_points_y":[4,5,60.9]},"region_attributes":{"Name":"Face_oval"}},'
    '{"shape_attributes":{"name":"rect"},"region_attributes":{"key":"brand","text":"%b"}},'
    '{"shape_attributes":{"name":"rect"},"region_attributes":{"field":"Photo","value":"x"}},'
    '{"shape_attributes":{"name":"rect"},"region_attributes":{"field":"note","text":""}}]},'
    '"b":{"filename":"other.jpg","regions":[{"shape_attributes":{"name":"rect"},"region_attributes":{"field":"z","text":"z"}}]}}}'
)
_SINGLE = (
    '{"filename":"%i.jpg","regions":[{"shape_attributes":{"name":"rect","x":%s,"y":2.7},'
    '"region_attributes":{"type":"face"}},{"shape_attributes":{"name":"rect"},"region_attributes":{"field":"name","text":"%n"}}]}'
)


def annotated(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Regions of one annotation text per part, in either layout, and each part's image."""
    key = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, _SINGLE).otherwise(_PROJECT)
    for mark, value in (
        ("%n", F.col("p_name")), ("%b", F.col("p_brand")), ("%i", key), ("%c", F.col("p_type")),
        ("%s", F.col("p_size").cast("string")),
    ):
        raw = F.replace(raw, F.lit(mark), value)
    rows = table(spark, folder, "part").select(
        key.alias("annotation"),
        F.col("p_type").alias("code"),
        key.alias("idx"),
        F.concat(key, F.lit(".jpg")).alias("filename"),
        raw.alias("text"),
    )
    # Parsed once; finding each image's entry and summing up its regions read the rows again.
    # Dealt out first, as a small compressed file holds many texts.
    dealt = rows.select("annotation", "text").repartition("annotation")
    entries = annotation_entries(dealt, ["annotation"])
    return materialize(explode_regions(entries, ["annotation"])), rows.drop("text")


@query(
    "annotation_fields",
    """SELECT p_partkey::VARCHAR AS annotation, field, value FROM part, LATERAL (
      SELECT 'name' AS field, p_name AS value
      UNION ALL SELECT 'brand', p_brand WHERE p_partkey % 3 <> 0
      UNION ALL SELECT 'note', '' WHERE p_partkey % 3 <> 0)""",
)
def _(spark, folder):
    built = annotations.image_fields(*annotated(spark, folder))
    return built.select("annotation", F.explode("fields").alias("field", "value"))


@query(
    "annotation_field_order",
    """SELECT p_partkey::VARCHAR AS annotation, CASE WHEN p_partkey % 3 = 0 THEN 'name: ' || p_name
      ELSE 'name: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'note: ' END AS gt_text FROM part""",
)
def _(spark, folder):
    from tallymark.functions.text import gt_text_join

    built = annotations.image_fields(*annotated(spark, folder))
    return built.select("annotation", gt_text_join(F.col("fields")).alias("gt_text"))


@query(
    "face_boxes",
    """SELECT p_partkey::VARCHAR AS annotation, CASE WHEN p_partkey % 3 = 0 THEN concat_ws(',', p_size, 2, 1, 1)
      ELSE concat_ws(',', least(1, p_size), 4, greatest(3, p_size) - least(1, p_size) + 1, 57) END AS face_box FROM part""",
)
def _(spark, folder):
    boxes = annotations.image_face_boxes(*annotated(spark, folder))
    shown = F.array_join(F.transform("face_box", lambda v: v.cast("string")), ",")
    return boxes.select("annotation", shown.alias("face_box"))


def captures(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Scan and photo of every part, and templates with the fields of the larger ones."""
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    prefixes = F.array(*[F.lit(p) for p in ("alb_id", "grc_passport", "rus_x", "ita_id")])
    code = F.get(prefixes, (F.col("p_partkey") % 4).cast("int"))
    base = part.select(code.alias("code"), key.alias("idx"), "p_name", "p_brand", "p_size")
    shots = base.withColumn("capture", F.explode(F.array(F.lit("scan"), F.lit("photo")))).select(
        "code", "idx", "capture", F.when(F.col("capture") == "scan", ".TIF").otherwise(".jpg").alias("suffix")
    )
    templates = base.where(F.col("p_size") > 20).select(
        "code", "idx",
        F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("fields"),
    )
    return shots, templates


CAPTURES = """
shots AS (
  SELECT ['alb_id', 'grc_passport', 'rus_x', 'ita_id'][p_partkey % 4 + 1] AS code, p_partkey::VARCHAR AS idx, capture,
    CASE WHEN p_size > 20 THEN 'name: ' || p_name || chr(10) || 'brand: ' || p_brand ELSE '' END AS gt_text,
    CASE WHEN p_size > 20 THEN 2 ELSE 0 END AS n_fields
  FROM part, (VALUES ('scan'), ('photo')) c(capture))"""


@query("template_join", f"WITH {CAPTURES} SELECT code, idx, capture, gt_text, n_fields FROM shots")
def _(spark, folder):
    joined = annotations.template_field_join(*captures(spark, folder))
    return joined.select("code", "idx", "capture", "gt_text", F.size("gt_fields").alias("n_fields"))


@query(
    "ocr_manifest",
    f"""WITH {CAPTURES} SELECT 'ocr_' || capture || '_' || code || '_' || idx AS id,
      'img/' || capture || '_' || code || '_' || idx || CASE capture WHEN 'scan' THEN '.tif' ELSE '.jpg' END AS path,
      code AS doc_type, gt_text, 'public_dataset' AS origin, capture, 'collection' AS source,
      CASE code WHEN 'alb_id' THEN 'latin' WHEN 'grc_passport' THEN 'greek' WHEN 'rus_x' THEN 'cyrillic' END AS script
    FROM shots""",
)
def _(spark, folder):
    return annotations.ocr_manifest_build(*captures(spark, folder), source="collection").drop("gt_fields")


# --- scorers ----------------------------------------------------------------------------------


@query(
    "batch_score",
    """SELECT doc_id AS id, CASE WHEN n_chars >= 200 THEN length(text)::DOUBLE / 20000e0 END AS score,
      CASE WHEN n_chars < 200 THEN 'ValueError: too short' END AS error FROM documents""",
)
def _(spark, folder):
    def scorer(record):
        if record["n_chars"] < 200:
            raise ValueError("too short")
        return len(record["text"]) / 20000.0

    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    scored = scoring.batch_score(docs, scorer, ["text", "n_chars"], retries=2, backoff_s=0.0, concurrency=4)
    return scored.drop("latency_ms")


@query(
    "batch_score_timeout",
    """SELECT doc_id AS id, CASE WHEN doc_id % 500 <> 3 THEN length(text)::DOUBLE / 20000e0 END AS score,
      CASE WHEN doc_id % 500 = 3 THEN 'timeout after 4.0s' END AS error FROM documents""",
)
def _(spark, folder):
    """Some calls never return: their processes are ended, and no other record is disturbed."""

    def scorer(record):
        import time

        while record["id"] % 500 == 3:
            time.sleep(60)
        return len(record["text"]) / 20000.0

    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    scored = scoring.batch_score(docs, scorer, ["id", "text"], retries=1, concurrency=4, timeout_s=4.0)
    return scored.drop("latency_ms")


# --- whole evaluations ------------------------------------------------------------------------


def forgery_run(spark, folder) -> evaluations.Evaluation:
    rows = scores(spark, folder)
    manifest = rows.select(
        "id",
        "label",
        F.when(F.col("domain") == "F", "field_collected").otherwise("public_dataset").alias("origin"),
        F.lit(None).cast("string").alias("fabrication"),
        F.when(F.col("domain") == "F", "cross_domain").when(F.col("domain") == "O", "in_domain").alias("eval_domain"),
    )
    return evaluations.evaluate_forgery(manifest, rows.select("id", "score"))


_FORGERY_DOMAINS = f"""
    renamed AS (SELECT CASE WHEN domain = 'F' THEN 'cross_domain' ELSE 'in_domain' END AS domain,
      score, label FROM fx_scores), {sweep_sql('renamed', 'domain')}, {maximin_sql()},
    sizes AS (SELECT domain, count(*) FILTER (WHERE label = 1) AS n_positive,
      count(*) FILTER (WHERE label = 0) AS n_negative FROM renamed GROUP BY domain),
    gates AS (SELECT domain, bool_or(fpr <= 0.348e0 AND tpr >= 0.88e0) AS roc_gate_pass FROM swept GROUP BY domain),
    best AS (SELECT domain, threshold AS best_threshold, tpr AS best_tpr, fpr AS best_fpr,
        "precision" AS best_precision, f1 AS best_f1 FROM swept
      QUALIFY row_number() OVER (PARTITION BY domain ORDER BY tpr - fpr DESC, threshold) = 1),
    domains AS (SELECT * FROM sizes JOIN operating USING (domain) JOIN gates USING (domain) JOIN best USING (domain))"""


@query(
    "evaluate_forgery",
    f"""WITH {SCORES}, {_FORGERY_DOMAINS}
    SELECT domain AS gate_domain, (SELECT count(*) = 0 FROM renamed WHERE domain = 'cross_domain') AS missing_cross_domain,
      * EXCLUDE (domain), (SELECT count(*) FROM fx_scores) AS n,
      (SELECT bool_and(domain = 'F') FROM fx_scores) AS trial_valid
    FROM domains ORDER BY domain <> 'cross_domain', domain <> 'in_domain', domain LIMIT 1""",
)
def _(spark, folder):
    return forgery_run(spark, folder).result


@query("evaluate_forgery_domains", f"WITH {SCORES}, {_FORGERY_DOMAINS} SELECT * FROM domains")
def _(spark, folder):
    return forgery_run(spark, folder).detail["domains"]


@query(
    "evaluate_forgery_origins",
    f"""WITH {SCORES} SELECT CASE WHEN domain = 'F' THEN 'field_collected' ELSE 'public_dataset' END AS origin,
      count(*) AS n FROM fx_scores GROUP BY 1""",
)
def _(spark, folder):
    return forgery_run(spark, folder).detail["origins"]


def document_run(spark, folder, **options) -> evaluations.Evaluation:
    """Parts as records; the second letter of the type stands for a capture, the brand for a document type."""
    records = parts(spark, folder)
    prefixes = F.array(*[F.lit(p) for p in ("alb_id", "grc_passport", "rus_x", "ita_id")])
    manifest = records.select(
        F.concat(F.when(F.col("id") % 3 == 0, "scan_").when(F.col("id") % 3 == 1, "photo_").otherwise("x_"), F.col("id").cast("string")).alias("id"),
        "row_index",
        "script",
        F.get(prefixes, (F.col("id") % 4).cast("int")).alias("doc_type"),
        "gt_fields",
        F.when(F.lower("script") == "promo", "field_collected").otherwise("public_dataset").alias("origin"),
    )
    keyed = records.drop("id").join(manifest.select("row_index", "id"), "row_index")
    return evaluations.evaluate_documents(manifest, keyed.select("id", "hyp_fields", "page"), **options)


_DOCUMENTS = f"""{FIELDS},
    judged AS (
      SELECT id AS row_index, CASE id % 3 WHEN 0 THEN 'scan_' WHEN 1 THEN 'photo_' ELSE 'x_' END || id AS id,
        CASE id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'photo' ELSE 'other' END AS capture, script,
        CASE id % 4 WHEN 0 THEN 'alb' WHEN 1 THEN 'grc' WHEN 2 THEN 'rus' ELSE 'unknown' END AS country, cer_field,
        lower(script) = 'promo' AS field_collected FROM items)"""

_DOCUMENT_RESULT = """round(avg(cer_field), 6) AS cer_field, count(*) AS n, count(cer_field) AS n_with_gt_fields,
      bool_and(field_collected) AS trial_valid, avg(cer_field) < 0.21e0 AS passed"""


@query(
    "evaluate_documents",
    f"""WITH {_DOCUMENTS} SELECT {_DOCUMENT_RESULT} FROM judged WHERE lower(script) IN ('economy', 'promo')""",
)
def _(spark, folder):
    done = document_run(spark, folder, scripts=["Economy", "PROMO"])
    return done.result.withColumn("cer_field", F.round("cer_field", 6))


@query(
    "evaluate_documents_breakdown",
    f"""WITH {_DOCUMENTS}, levels AS (
      SELECT 'overall' AS level, '' AS key, avg(cer_field) AS c, count(*) AS n,
             count(cer_field) AS n_with_gt_fields, NULL AS script FROM judged
      UNION ALL SELECT 'script', script, avg(cer_field), count(*), count(cer_field), NULL FROM judged GROUP BY script
      UNION ALL SELECT 'country', country, avg(cer_field), count(*), count(cer_field),
             arg_min(script, row_index) FROM judged GROUP BY country)
    SELECT level, key, round(c, 6) AS cer_field, n, n_with_gt_fields, script,
      CASE WHEN level = 'country' THEN CASE key WHEN 'grc' THEN 'el' ELSE 'en' END END AS lang_code_used FROM levels""",
)
def _(spark, folder):
    done = document_run(spark, folder, lang_by_country={"grc": "el", "rus": ""})
    return done.detail["breakdown"].withColumn("cer_field", F.round("cer_field", 6))


@query(
    "evaluate_documents_sampled",
    f"""WITH {_DOCUMENTS}, countries AS (
      SELECT country, row_number() OVER (ORDER BY country) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT country FROM judged)),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY country, capture ORDER BY md5('42:' || id), id) AS k FROM judged),
    turns AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY capture = 'other', k, capture <> 'scan', id) AS turn
      FROM drawn),
    picked AS (SELECT t.* FROM turns t JOIN countries USING (country)
      WHERE turn <= 101 // n + CASE WHEN place <= 101 - 101 // n * n THEN 1 ELSE 0 END)
    SELECT {_DOCUMENT_RESULT} FROM picked""",
)
def _(spark, folder):
    done = document_run(spark, folder, max_samples=101)
    return done.result.withColumn("cer_field", F.round("cer_field", 6))


@query(
    "evaluate_faces",
    f"""WITH {PAIRS}, facts AS (SELECT bool_or(coalesce(pair_warning, '') LIKE 'under_variation%'
        OR coalesce(pair_warning, '') = 'single_image_augment_forbidden'
        OR (same AND capture_a IN ('photo', 'scan', 'video_frame') AND capture_b IN ('photo', 'scan', 'video_frame')))
        AS under_variation, bool_and(origin = 'field_collected') AS trial_valid FROM fx_pairs)
    SELECT s.*, under_variation, CASE WHEN under_variation THEN 'blocked' ELSE 'ok' END AS threshold_lock, trial_valid
    FROM ({pair_sweep_sql(0.84, 0.8)}) s, facts""",
)
def _(spark, folder):
    rows = pairs(spark, folder)
    return evaluations.evaluate_faces(
        rows.drop("similarity", "backend"), rows.select("id", "similarity", "backend")
    ).result


@query(
    "fatal_report",
    """WITH failed AS (
      SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'no score'
        WHEN o_orderpriority = '1-URGENT' THEN 'timeout' WHEN o_custkey % 7 = 0 THEN 'null score' END AS reason FROM orders)
    SELECT id, reason, count(*) OVER () AS n_failed FROM failed WHERE reason IS NOT NULL ORDER BY id, reason LIMIT 50""",
)
def _(spark, folder):
    """The report of a void run lists the first fifty failures."""
    orders = table(spark, folder, "orders")
    told = orders.where(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 500000.0).alias("score"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "timeout").alias("error"),
    )
    failed = validation.unscored(orders.select(F.col("o_orderkey").alias("id")), told, "id", "score")
    return validation.fatal_report(failed, ["id", "reason"])


@query(
    "endpoint_identity",
    """WITH want(name, expected) AS (VALUES ('ocr', 'ocr'), ('face', 'face'), ('forgery', 'forgery'), ('identity', 'identity')),
    seen AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'face' ELSE 'forgery' END AS name,
      CASE user_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN event_type END AS got FROM events)
    SELECT name, expected, got, CASE WHEN seen.name IS NULL THEN 'missing'
      WHEN got IS NULL OR got <> expected THEN 'wrong_service' END AS reason FROM want LEFT JOIN seen USING (name)""",
)
def _(spark, folder):
    """Services as their events tell them: one right, one that answers as others, one nameless, one silent."""
    kind = F.col("user_id") % 3
    seen = table(spark, folder, "events").select(
        F.when(kind == 0, "ocr").when(kind == 1, "face").otherwise("forgery").alias("name"),
        F.when(kind == 0, F.lit("ocr")).when(kind == 1, F.col("event_type")).alias("service"),
    )
    return validation.endpoint_identity_check(seen.distinct())


@query(
    "evaluate_identity",
    f"""WITH {RESOLVED} SELECT round(avg(coalesce(score, 0)), 6) AS mean_score, count(*) AS n
    FROM customer LEFT JOIN scored ON person = c_name""",
)
def _(spark, folder):
    resume, supplied, statuses = handle_rows(spark, folder)
    done = evaluations.evaluate_identity(
        persons(spark, folder), resume, supplied, statuses,
        weights={"github": 2.0, "leetcode": 1.0, "codeforces": 1.5},
    )
    return done.result.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "freeze_strict",
    """WITH frozen AS (SELECT lang, count(*) % 2 = 0 AS unknown, count(*) % 3 = 0 AS dirty,
        min(length(text)) < 15 AS missing FROM documents GROUP BY lang)
    SELECT 'model_missing' AS rule, 'no frozen model weights' AS message FROM frozen WHERE missing
    UNION ALL SELECT 'commit_unknown', 'commit is unknown' FROM frozen WHERE unknown
    UNION ALL SELECT 'tree_dirty', 'working tree has changes' FROM frozen WHERE dirty""",
)
def _(spark, folder):
    by_lang = table(spark, folder, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("least")
    )
    freeze = by_lang.select(
        F.when(F.col("least") >= 15, "abc").alias("model_sha256"),
        F.when(F.col("n") % 2 == 0, "unknown").otherwise("abc").alias("git_commit"),
        (F.col("n") % 3 == 0).alias("git_dirty"),
    )
    return provenance.freeze_strict_rules(freeze)
