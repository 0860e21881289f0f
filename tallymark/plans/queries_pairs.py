"""Face pairs, similarities, quality gates and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import geometry, vectors
from tallymark.operators import pairing, provenance, validation
from tallymark.plans.catalog import query, table
from tallymark.plans.queries_scores import maximin_sql, sweep_sql


def images(spark, folder) -> DataFrame:
    """Vectors as images: a hundred identities, four capture kinds, several images of each."""
    key = F.col("vec_id")
    kinds = F.array(*[F.lit(k) for k in ("photo", "scan", "video_frame", "sketch")])
    return table(spark, folder, "embeddings").select(
        F.format_string("p%03d", key % 97).alias("identity"),
        F.get(kinds, (F.floor(key / 97) % 4).cast("int")).alias("capture"),
        F.format_string("img/%06d.jpg", key).alias("path"),
    )


IMAGES = """
images AS (
  SELECT printf('p%03d', vec_id % 97) AS identity,
    ['photo', 'scan', 'video_frame', 'sketch'][(vec_id // 97) % 4 + 1] AS capture,
    printf('img/%06d.jpg', vec_id) AS path FROM embeddings)"""


@query(
    "same_pairs",
    f"""WITH {IMAGES}, firsts AS (
      SELECT identity, capture, min(path) AS path, CASE capture WHEN 'photo' THEN 1 WHEN 'scan' THEN 2
        WHEN 'video_frame' THEN 3 END AS o FROM images WHERE capture <> 'sketch' GROUP BY ALL)
    SELECT a.identity, a.capture AS capture_a, b.capture AS capture_b, a.path AS img_a, b.path AS img_b
    FROM firsts a JOIN firsts b ON a.identity = b.identity AND a.o < b.o""",
)
def _(spark, folder):
    return pairing.same_pairs(images(spark, folder))


def circle_sql(ids: str, seed: str, n_diff: str, alternate: bool = True) -> str:
    """CTE ``diffs``: pairs on the seeded circle, from (id) rows of ``ids``."""
    if alternate:
        first = "CASE WHEN ((a.i + b.i) % 2 = 0) = (a.i < b.i) THEN a.id ELSE b.id END"
        second = "CASE WHEN ((a.i + b.i) % 2 = 0) = (a.i < b.i) THEN b.id ELSE a.id END"
    else:
        first, second = "least(a.id, b.id)", "greatest(a.id, b.id)"
    return f"""
circle AS (SELECT id, row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS i,
                  count(*) OVER () AS n FROM {ids}),
wanted AS (SELECT any_value(n) AS n, least({n_diff}, any_value(n) * (any_value(n) - 1) // 2) AS target
           FROM circle),
slots AS (SELECT unnest(range(target)) AS s, n FROM wanted),
diffs AS (
  SELECT s + 1 AS pair, {first} AS identity_a, {second} AS identity_b
  FROM slots JOIN circle a ON a.i = s % slots.n JOIN circle b ON b.i = (s % slots.n + s // slots.n + 1) % slots.n)"""


@query(
    "diff_pairs",
    f"""WITH ids AS (SELECT c_name AS id FROM customer), {circle_sql('ids', '42', '4000')}
    SELECT * FROM diffs""",
)
def _(spark, folder):
    ids = table(spark, folder, "customer").select(F.col("c_name").alias("id"))
    return pairing.diff_pairs(ids, 4000, 42)


@query(
    "random_distinct_pairs",
    f"""WITH ids AS (SELECT s_name AS id FROM supplier),
    {circle_sql('ids', '7', '(SELECT count(*) FROM supplier)', False)} SELECT * FROM diffs""",
)
def _(spark, folder):
    ids = table(spark, folder, "supplier").select(F.col("s_name").alias("id"))
    return pairing.diff_pairs(ids, ids.agg(F.count(F.lit(1))).scalar(), 7, sides="sorted")


@query(
    "pair_manifest",
    f"""WITH {IMAGES}, people AS (
      SELECT identity AS id, min(path) AS img_a, max(path) AS img_b FROM images GROUP BY identity),
    {circle_sql('people', '42', '150')}
    SELECT 'fc_same_' || printf('%04d', row_number() OVER (ORDER BY id)) AS id, img_a, img_b,
      true AS same, id AS identity_id, NULL AS identity_a, NULL AS identity_b,
      'public_dataset' AS origin, 'scan' AS capture_a, 'photo' AS capture_b,
      'under_variation:scan_photo' AS pair_warning FROM people
    UNION ALL
    SELECT 'fc_diff_' || printf('%04d', pair), l.img_a, r.img_b, false, NULL, identity_a, identity_b,
      'public_dataset', 'scan', 'photo', 'under_variation:scan_photo'
    FROM diffs JOIN people l ON l.id = identity_a JOIN people r ON r.id = identity_b""",
)
def _(spark, folder):
    people = images(spark, folder).groupBy("identity").agg(
        F.min("path").alias("img_a"), F.max("path").alias("img_b")
    )
    return pairing.pair_manifest(
        people, 150, 42, "public_dataset", ("scan", "photo"), "under_variation:scan_photo"
    )


@query(
    "paired_captures",
    """WITH shots AS (SELECT p_brand AS code, p_partkey // 2 AS idx, p_partkey AS k,
        p_size > 4 AS boxed FROM part)
    SELECT s.code, s.idx, 'scan/' || s.k AS scan_path, 'photo/' || p.k AS photo_path
    FROM shots s JOIN shots p USING (code, idx) WHERE s.boxed AND p.boxed""",
)
def _(spark, folder):
    shots = table(spark, folder, "part").select(
        F.col("p_brand").alias("code"),
        F.floor(F.col("p_partkey") / 2).alias("idx"),
        F.col("p_partkey").cast("string").alias("k"),
        F.when(F.col("p_size") > 4, F.array(F.col("p_size"))).alias("face_box"),
    )
    return pairing.paired_captures(
        shots.withColumn("path", F.concat(F.lit("scan/"), "k")),
        shots.withColumn("path", F.concat(F.lit("photo/"), "k")),
    )


_CAPTURE_FOLDERS = ("doc/a.jpg", "selfie/b.jpg", "id.png", "live.png", "x.jpg", "photo/z.jpg", "y.jpg", "webcam/q.jpg")


@query(
    "capture_pick",
    """WITH files AS (
      SELECT printf('c%04d', o_custkey) AS identity, printf('c%04d', o_custkey) || '/'
        || ['doc/a.jpg','selfie/b.jpg','id.png','live.png','x.jpg','photo/z.jpg','y.jpg','webcam/q.jpg']
           [o_orderkey % 8 + 1] AS path FROM orders GROUP BY ALL),
    ranked AS (
      SELECT identity, path, string_split(path, '/') AS parts,
        list_position(['doc','id','photo','document','id_photo','aadhaar_photo'],
           CASE WHEN len(string_split(path, '/')) = 3 THEN string_split(path, '/')[2]
                ELSE split_part(string_split(path, '/')[2], '.', 1) END) AS d,
        list_position(['selfie','live','capture','webcam','phone'],
           CASE WHEN len(string_split(path, '/')) = 3 THEN string_split(path, '/')[2]
                ELSE split_part(string_split(path, '/')[2], '.', 1) END) AS s,
        CASE WHEN len(string_split(path, '/')) = 3 THEN 0 ELSE 1 END AS deep FROM files),
    picks AS (
      SELECT identity,
        min(printf('%d%02d', deep, d) || path) FILTER (WHERE d > 0) AS doc,
        min(printf('%d%02d', deep, s) || path) FILTER (WHERE s > 0) AS selfie FROM ranked GROUP BY identity),
    ordered AS (SELECT identity, path, row_number() OVER (PARTITION BY identity ORDER BY parts) AS r FROM ranked),
    two AS (SELECT identity, max(path) FILTER (WHERE r = 1) AS one, max(path) FILTER (WHERE r = 2) AS two
            FROM ordered GROUP BY identity)
    SELECT identity, CASE WHEN doc IS NOT NULL AND selfie IS NOT NULL THEN substr(doc, 4) ELSE one END AS doc,
      CASE WHEN doc IS NOT NULL AND selfie IS NOT NULL THEN substr(selfie, 4) ELSE two END AS selfie
    FROM picks JOIN two USING (identity)
    WHERE (doc IS NOT NULL AND selfie IS NOT NULL) OR two IS NOT NULL""",
)
def _(spark, folder):
    names = F.array(*[F.lit(n) for n in _CAPTURE_FOLDERS])
    files = table(spark, folder, "orders").select(
        F.concat(
            F.format_string("c%04d/", "o_custkey"), F.get(names, (F.col("o_orderkey") % 8).cast("int"))
        ).alias("rel_path")
    ).distinct()
    return pairing.identity_capture_pick(files)


@query(
    "diff_target_clamp",
    """SELECT p_partkey AS id,
      least(greatest(0, p_size * 9), (p_partkey % 260) * (p_partkey % 260 - 1) // 2) AS smoke,
      greatest(150, least(250, greatest(least(greatest(150, least(250, p_size * 9)), 500 - p_partkey % 260),
               300 - p_partkey % 260))) AS field FROM part""",
)
def _(spark, folder):
    same, want = F.col("p_partkey") % 260, F.col("p_size") * 9
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        pairing.diff_target_clamp(same, want, "dev_fixture").alias("smoke"),
        pairing.diff_target_clamp(same, want, "field_collected").alias("field"),
    )


def pairs(spark, folder) -> DataFrame:
    """Each vector with its twenty successors: similarity, same label, origin and captures."""
    v = table(spark, folder, "embeddings").select(
        "vec_id", "label", "embedding", vectors.norm(F.col("embedding")).alias("norm")
    )
    left = v.select(
        F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("ea"),
        F.col("norm").alias("na"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"),
    ).withColumn("b", F.col("a") + F.col("k"))
    right = v.select(
        F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("eb"),
        F.col("norm").alias("nb"),
    )
    similarity = vectors.cosine_unit(F.col("ea"), F.col("eb"), F.col("na"), F.col("nb"))
    kinds = F.array(*[F.lit(c) for c in ("photo", "scan", "doc", "selfie")])
    warning = F.when(F.col("a") % 50 == 0, "under_variation:x").when(
        F.col("a") % 50 == 1, "single_image_augment_forbidden"
    )
    joined = left.join(right, "b").select("*", F.round(similarity, 6).alias("_sim"))
    return joined.select(
        F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")).alias("id"),
        F.when(F.col("_sim") < 0.35, None).otherwise(F.col("_sim")).alias("similarity"),
        (F.col("la") == F.col("lb")).alias("same"),
        F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("backend"),
        F.when(F.col("a") % 40 == 3, "public_dataset").otherwise("field_collected").alias("origin"),
        F.get(kinds, (F.col("a") % 4).cast("int")).alias("capture_a"),
        F.get(kinds, (F.col("b") % 4).cast("int")).alias("capture_b"),
        warning.alias("pair_warning"),
        (F.col("a") % 60).alias("part"),
    )


PAIRS = """
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    round(greatest(0e0, least(1e0, (list_cosine_similarity(a.e, b.e) + 1e0) / 2e0)), 6) AS sim
  FROM vecs a JOIN vecs b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 20),
fx_pairs AS (
  SELECT a || '_' || b AS id, CASE WHEN sim < 0.35e0 THEN NULL ELSE sim END AS similarity, same,
    CASE WHEN (b - a) % 2 = 0 THEN 'even' ELSE 'odd' END AS backend,
    CASE WHEN a % 40 = 3 THEN 'public_dataset' ELSE 'field_collected' END AS origin,
    ['photo', 'scan', 'doc', 'selfie'][a % 4 + 1] AS capture_a,
    ['photo', 'scan', 'doc', 'selfie'][b % 4 + 1] AS capture_b,
    CASE a % 50 WHEN 0 THEN 'under_variation:x' WHEN 1 THEN 'single_image_augment_forbidden' END
      AS pair_warning, a % 60 AS part
  FROM sims)"""


@query("pair_similarity", f"WITH {PAIRS} SELECT id, similarity, same FROM fx_pairs")
def _(spark, folder):
    return pairs(spark, folder).select("id", "similarity", "same")


_PAIR_SWEEP = sweep_sql("scored", "backend").replace("tpr", "sensitivity")


def pair_sweep_sql(ta: float, tb: float) -> str:
    return f"""WITH {PAIRS},
    scored AS (SELECT backend, similarity AS score, same::INTEGER AS label FROM fx_pairs
               WHERE similarity IS NOT NULL),
    {_PAIR_SWEEP}, {maximin_sql('backend', 'sensitivity', ta, 'accuracy', tb)},
    counts AS (SELECT backend, count(*) AS n, count(similarity) AS n_scored,
                 count(*) FILTER (WHERE similarity IS NULL) AS null_count FROM fx_pairs GROUP BY backend)
    SELECT * FROM counts LEFT JOIN operating USING (backend)"""


@query("scored_pair_sweep", pair_sweep_sql(0.84, 0.8))
def _(spark, folder):
    return pairing.scored_pair_sweep(pairs(spark, folder))


@query("scored_pair_sweep_lenient", pair_sweep_sql(0.3, 0.4))
def _(spark, folder):
    return pairing.scored_pair_sweep(
        pairs(spark, folder), targets={"sensitivity": 0.3, "accuracy": 0.4}
    )


@query(
    "under_variation",
    f"""WITH {PAIRS}, flagged AS (SELECT part, bool_or(coalesce(pair_warning, '') LIKE 'under_variation%'
        OR coalesce(pair_warning, '') = 'single_image_augment_forbidden'
        OR (same AND capture_a IN ('photo', 'scan', 'video_frame')
                 AND capture_b IN ('photo', 'scan', 'video_frame'))) AS under_variation
      FROM fx_pairs GROUP BY part)
    SELECT *, CASE WHEN under_variation THEN 'blocked' ELSE 'ok' END AS threshold_lock FROM flagged""",
)
def _(spark, folder):
    return provenance.under_variation_flag(pairs(spark, folder), ["part"])


@query(
    "trial_violations",
    f"""WITH {PAIRS}, facts AS (SELECT count(*) AS n, count(*) FILTER (WHERE same) AS s,
        count(*) FILTER (WHERE NOT same) AS d,
        count(*) FILTER (WHERE origin <> 'field_collected') AS nf,
        count(*) FILTER (WHERE pair_warning LIKE 'under_variation%') AS u FROM fx_pairs)
    SELECT 'origin_not_field' AS rule, 'public_dataset' AS message FROM facts WHERE nf > 0
    UNION ALL SELECT 'under_variation', u::VARCHAR FROM facts WHERE u > 0
    UNION ALL SELECT 'same_band', s || ' outside [150, 250]' FROM facts WHERE s NOT BETWEEN 150 AND 250
    UNION ALL SELECT 'diff_band', d || ' outside [150, 250]' FROM facts WHERE d NOT BETWEEN 150 AND 250
    UNION ALL SELECT 'total_band', n || ' outside [300, 500]' FROM facts WHERE n NOT BETWEEN 300 AND 500
    UNION ALL SELECT 'threshold_on_non_field', 'threshold is set' FROM facts WHERE nf > 0
    UNION ALL SELECT 'last_run_blocked', 'last run blocks the threshold lock' FROM facts
    UNION ALL SELECT 'last_run_not_field', 'dev_fixture' FROM facts""",
)
def _(spark, folder):
    return provenance.trial_rules(
        pairs(spark, folder), 0.5, True, ["dev_fixture", "field_collected"]
    )


@query(
    "pair_count_bands",
    f"""WITH {PAIRS}, facts AS (SELECT count(*) FILTER (WHERE same) AS s,
        count(*) FILTER (WHERE NOT same) AS d FROM fx_pairs)
    SELECT 'same_band' AS rule, s || ' outside [150, 250]' AS message FROM facts WHERE s NOT BETWEEN 150 AND 250
    UNION ALL SELECT 'diff_band', d || ' outside [150, 250]' FROM facts WHERE d NOT BETWEEN 150 AND 250
    UNION ALL SELECT 'total_band', (s + d) || ' outside [300, 500]' FROM facts
      WHERE s + d NOT BETWEEN 300 AND 500""",
)
def _(spark, folder):
    counts = pairs(spark, folder).agg(
        F.count_if(F.col("same")).alias("n_same"), F.count_if(~F.col("same")).alias("n_diff")
    )
    return pairing.pair_count_bands(counts, "field_collected")


def faces(spark, folder) -> DataFrame:
    """Landmarks and image figures out of the numbers of a vector."""
    e = [F.col("embedding")[i].cast("double") * 100.0 for i in range(16)]
    points = F.array(*[F.array(e[2 * i], e[2 * i + 1]) for i in range(5)])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        points.alias("landmarks"),
        (F.abs(e[10]) * 8.0).alias("face_side_px"),
        (F.abs(e[11]) * 10.0).alias("laplacian_var"),
        F.when(F.col("label") == 3, "fullframe_fallback").otherwise("detector").alias("detect_source"),
        F.lit(200.0).alias("image_width"),
    )


FACES = """
pts AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * 100e0) AS e FROM embeddings),
faces AS (
  SELECT id, label, abs(e[11]) * 8e0 AS side, abs(e[12]) * 10e0 AS blur,
    sqrt((e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2) AS eye_distance,
    (e[5] - (e[1] + e[3]) / 2e0) AS nose_dx, (e[2] + e[4]) / 2e0 AS eye_y,
    (e[8] + e[10]) / 2e0 - (e[2] + e[4]) / 2e0 AS dropped, e[6] AS nose_y FROM pts),
posed AS (
  SELECT *, greatest(-90e0, least(90e0, nose_dx / (eye_distance + 1e-6) * 60e0)) AS yaw,
    greatest(-90e0, least(90e0, (eye_y + dropped * 0.45e0 - nose_y) / (abs(dropped) + 1e-6) * 40e0)) AS pitch
  FROM faces)"""


def posed(spark, folder) -> DataFrame:
    marks = F.col("landmarks")
    return faces(spark, folder).withColumns(
        {
            "yaw_deg": geometry.yaw_deg(marks),
            "pitch_deg": geometry.pitch_deg(marks),
            "eye_distance_ratio": geometry.eye_distance(marks) / F.col("image_width"),
        }
    )


@query(
    "pose",
    f"""WITH {FACES} SELECT id, round(yaw, 6) AS yaw_deg, round(pitch, 6) AS pitch_deg,
      round(eye_distance, 6) AS eye_distance FROM posed""",
)
def _(spark, folder):
    return posed(spark, folder).select(
        "id",
        F.round("yaw_deg", 6).alias("yaw_deg"),
        F.round("pitch_deg", 6).alias("pitch_deg"),
        F.round(F.col("eye_distance_ratio") * 200.0, 6).alias("eye_distance"),
    )


@query(
    "quality_gate",
    f"""WITH {FACES} SELECT id, concat_ws(',', CASE WHEN side < 40 THEN 'face_too_small' END,
        CASE WHEN blur < 50 THEN 'too_blurry' END, CASE WHEN abs(yaw) > 30 THEN 'yaw_out_of_range' END,
        CASE WHEN abs(pitch) > 25 THEN 'pitch_out_of_range' END,
        CASE WHEN label = 3 THEN 'fullframe_fallback' END) AS flags,
      side >= 40 AND blur >= 50 AND abs(yaw) <= 30 AND abs(pitch) <= 25 AS passed FROM posed""",
)
def _(spark, folder):
    gated = validation.quality_gate(posed(spark, folder))
    return gated.select("id", F.array_join("flags", ",").alias("flags"), "passed")


@query(
    "quality_gate_eye",
    f"""WITH {FACES} SELECT id, concat_ws(',', CASE WHEN side < 40 THEN 'face_too_small' END,
        CASE WHEN eye_distance / 200e0 < 0.05e0 THEN 'eye_distance_too_small' END,
        CASE WHEN blur < 50 THEN 'too_blurry' END,
        CASE WHEN abs(yaw) > 30 THEN 'yaw_out_of_range' END) AS flags,
      side >= 40 AND eye_distance / 200e0 >= 0.05e0 AND blur >= 50 AND abs(yaw) <= 30 AS passed
    FROM posed""",
)
def _(spark, folder):
    gated = validation.quality_gate(posed(spark, folder), eye_variant=True)
    return gated.select("id", F.array_join("flags", ",").alias("flags"), "passed")
