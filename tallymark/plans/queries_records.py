"""Character error rates, samples, splits, manifests and their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.functions.fields import bbox_backed_text, unwrap_fields
from tallymark.functions.geometry import flat_to_box, quad_to_box
from tallymark.operators import cer as cer_ops
from tallymark.operators import provenance, sampling, splits, validation
from tallymark.plans.catalog import query, table
from tallymark.session import materialize

# --- character error rates --------------------------------------------------------------------


def parts(spark, folder) -> DataFrame:
    """One record per part: two ground-truth fields, one of them distorted in the hypothesis.

    The brand is found under an upper-case key; every fifth record lacks the name field, so that
    its name is searched in the page text.
    """
    part = table(spark, folder, "part")
    hyp = F.replace(F.replace("p_name", F.lit("e"), F.lit("a")), F.lit("in"), F.lit("im"))
    paged = F.col("p_partkey") % 5 == 0
    brand_key, name_key = F.lit("BRAND"), F.lit("name")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").alias("row_index"),
        F.col("p_brand").alias("country"),
        F.col("p_type").alias("script"),
        F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("gt_fields"),
        F.when(paged, F.create_map(brand_key, F.col("p_brand")))
        .otherwise(F.create_map(name_key, hyp, brand_key, F.col("p_brand")))
        .alias("hyp_fields"),
        F.concat(F.lit("no. "), F.col("p_partkey").cast("string"), F.lit(" "), hyp, F.lit(" x")).alias("page"),
    )


def items(spark, folder) -> DataFrame:
    return cer_ops.record_items(parts(spark, folder), ["row_index", "country", "script"])


FIELDS = """
fx_parts AS (
  SELECT p_partkey AS id, p_brand AS country, p_type AS script, p_name AS ref,
         replace(replace(p_name, 'e', 'a'), 'in', 'im') AS hyp, p_brand AS brand,
         'no. ' || p_partkey || ' ' || replace(replace(p_name, 'e', 'a'), 'in', 'im') || ' x' AS page
  FROM part),
windows AS (
  SELECT id, ref, page, w, i, levenshtein(substr(page, i, w), ref) AS edits
  FROM (SELECT id, ref, page, unnest(range(greatest(1, length(ref) - 2), length(ref) + 3)) AS w
        FROM fx_parts WHERE id % 5 = 0), LATERAL (SELECT unnest(range(1, length(page) - w + 2)) AS i)
  WHERE NOT contains(page, ref)),
best AS (
  SELECT id, edits, w, i, substr(page, i, w) AS span FROM windows
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY edits, w, i) = 1),
field_rows AS (
  SELECT id, 'brand' AS field, 0e0 AS cer, brand AS gt, brand AS hyp, 'fields' AS "match" FROM fx_parts
  UNION ALL
  SELECT id, 'name', levenshtein(hyp, ref)::DOUBLE / length(ref), ref, hyp, 'fields'
  FROM fx_parts WHERE id % 5 <> 0
  UNION ALL
  SELECT p.id, 'name',
         CASE WHEN contains(page, ref) THEN 0e0 WHEN edits < length(ref)
              THEN edits::DOUBLE / length(ref) ELSE 1e0 END,
         ref, CASE WHEN contains(page, ref) THEN ref WHEN edits < length(ref) THEN span ELSE '' END,
         'page_window'
  FROM fx_parts p LEFT JOIN best USING (id) WHERE p.id % 5 = 0),
items AS (
  SELECT id, sum(cer * greatest(length(gt), 1)) / sum(greatest(length(gt), 1)) AS cer_field,
         count(*) AS n_fields, any_value(country) AS country, any_value(script) AS script
  FROM field_rows JOIN (SELECT id, country, script FROM fx_parts) USING (id) GROUP BY id)"""


@query("field_cer", f'WITH {FIELDS} SELECT id, field, cer, gt, hyp, "match" FROM field_rows')
def _(spark, folder):
    return cer_ops.field_rows(parts(spark, folder))


@query(
    "page_window_cer",
    """WITH pages AS (
      SELECT p_partkey AS id, p_name AS ref, 'no. ' || p_partkey || ' '
        || replace(replace(p_name, 'e', 'a'), 'in', 'im') || ' x' AS page FROM part),
    windows AS (
      SELECT id, ref, w, i, substr(page, i, w) AS span, levenshtein(substr(page, i, w), ref) AS edits
      FROM (SELECT *, unnest(range(greatest(1, length(ref) - 2), length(ref) + 3)) AS w FROM pages),
           LATERAL (SELECT unnest(range(1, length(page) - w + 2)) AS i)),
    best AS (SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY id ORDER BY edits, w, i) = 1)
    SELECT id, ref, CASE WHEN contains(page, ref) THEN 0e0 WHEN edits < length(ref)
        THEN edits::DOUBLE / length(ref) ELSE 1e0 END AS cer,
      CASE WHEN contains(page, ref) THEN ref WHEN edits < length(ref) THEN span ELSE '' END AS hyp
    FROM pages LEFT JOIN (SELECT id, edits, span FROM best) USING (id)""",
)
def _(spark, folder):
    pages = parts(spark, folder).select("id", F.col("gt_fields")["name"].alias("ref"), "page")
    return cer_ops.page_window_rows(pages).select("id", "ref", "cer", "hyp")


@query(
    "cer_micro",
    f"WITH {FIELDS} SELECT id, round(cer_field, 9) AS cer_field, n_fields FROM items",
)
def _(spark, folder):
    rows = cer_ops.field_rows(parts(spark, folder))
    return cer_ops.cer_micro(rows).withColumn("cer_field", F.round("cer_field", 9))


@query(
    "cer_macro",
    f"""WITH {FIELDS} SELECT round(avg(cer_field), 6) AS cer_field, count(*) AS n,
    count(cer_field) AS n_with_gt_fields FROM items""",
)
def _(spark, folder):
    out = cer_ops.cer_macro(items(spark, folder))
    return out.withColumn("cer_field", F.round("cer_field", 6))


@query(
    "cer_breakdown",
    f"""WITH {FIELDS}, levels AS (
      SELECT 'overall' AS level, '' AS key, avg(cer_field) AS c, count(*) AS n,
             count(cer_field) AS n_with_gt_fields, NULL AS script FROM items
      UNION ALL SELECT 'script', script, avg(cer_field), count(*), count(cer_field), NULL
      FROM items GROUP BY script
      UNION ALL SELECT 'country', country, avg(cer_field), count(*), count(cer_field),
             arg_min(script, id) FROM items GROUP BY country)
    SELECT level, key, round(c, 6) AS cer_field, n, n_with_gt_fields, script,
      CASE WHEN level = 'country' THEN
        CASE key WHEN 'Brand#1' THEN 'fr' WHEN 'Brand#2' THEN 'de' ELSE 'en' END END AS lang_code_used
    FROM levels""",
)
def _(spark, folder):
    languages = {"Brand#1": "fr", "Brand#2": "de", "Brand#3": ""}
    out = cer_ops.cer_breakdown(items(spark, folder), languages)
    return out.withColumn("cer_field", F.round("cer_field", 6))


@query(
    "running_cer",
    f"""WITH {FIELDS} SELECT id, script, round(avg(cer_field) OVER
      (PARTITION BY script ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS running_cer_field FROM items""",
)
def _(spark, folder):
    # Chunk totals and rows both read the error rates.
    out = cer_ops.running_cer(materialize(items(spark, folder)), ["script"], chunk_rows=100)
    return out.select(
        "id", "script", F.round("running_cer_field", 6).alias("running_cer_field")
    )


@query(
    "unwrap_fields",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'brand=' || p_brand END
       || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN ';' ELSE '' END
       || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'name=' || p_name END AS kept,
       CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN 'raw'
            ELSE concat_ws('/', CASE WHEN p_partkey % 3 <> 0 THEN p_brand END,
                                CASE WHEN p_partkey % 4 <> 0 THEN p_name END) END AS page_text
    FROM part""",
)
def _(spark, folder):
    none = F.lit(None)
    box = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])

    def field(value, bbox):
        return F.struct(
            value.alias("value"), bbox.cast("array<double>").alias("bbox"),
            none.cast("double").alias("confidence"),
        )

    key = F.col("p_partkey")
    fields = F.create_map(
        F.lit("brand"), field(F.col("p_brand"), F.when(key % 3 != 0, box)),
        F.lit("name"), field(F.when(key % 4 != 0, F.col("p_name")), box),
    )
    records = table(spark, folder, "part").select(key.alias("id"), fields.alias("fields"))
    kept = F.transform(
        F.map_entries(unwrap_fields(F.col("fields"))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    text = F.replace(bbox_backed_text(F.col("fields"), F.lit("raw")), F.lit("\n"), F.lit("/"))
    return records.select("id", F.array_join(kept, ";").alias("kept"), text.alias("page_text"))


@query(
    "quad_box",
    """SELECT p_partkey AS id, concat_ws(',', least(p_size, 30 - p_size, 7), least(p_retailprice, 950e0, 901e0),
         greatest(p_size, 30 - p_size, 7), greatest(p_retailprice, 950e0, 901e0)) AS quad,
       CASE p_partkey % 3 WHEN 0 THEN concat_ws(',', p_size, 2, 3, 4)
         WHEN 1 THEN concat_ws(',', least(p_size, 3, 5), 2, greatest(p_size, 3, 5), 6) END AS flat
    FROM (SELECT p_partkey, p_size::DOUBLE::INTEGER AS p_size, p_retailprice FROM part)""",
)
def _(spark, folder):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")

    def shown(box):
        # Whole numbers print without a fraction on the size axis, as the prices do with one.
        return F.concat_ws(
            ",", box[0].cast("int").cast("string"), box[1].cast("string"),
            box[2].cast("int").cast("string"), box[3].cast("string"),
        )

    points = F.array(
        F.array(size, price), F.array(F.lit(30.0) - size, F.lit(950.0)), F.array(F.lit(7.0), F.lit(901.0))
    )
    flat = F.when(
        F.col("p_partkey") % 3 == 0, F.array(size, F.lit(2.0), F.lit(3.0), F.lit(4.0))
    ).when(
        F.col("p_partkey") % 3 == 1,
        F.array(size, F.lit(2.0), F.lit(3.0), F.lit(6.0), F.lit(5.0), F.lit(4.0)),
    ).otherwise(F.array(size, F.lit(2.0), F.lit(3.0)))
    box = flat_to_box(flat)
    whole = F.transform(box, lambda v: v.cast("int").cast("string"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        shown(quad_to_box(points)).alias("quad"),
        F.when(box.isNotNull(), F.concat_ws(",", whole)).alias("flat"),
    )


_WORDS = (
    (0, " University of"), (1, " worked as a"), (2, " GPA 3.1"), (3, " Date of birth"), (4, ""), (5, ""),
)


@query(
    "doc_type",
    """WITH texts AS (
      SELECT doc_id AS id, upper(text || CASE doc_id % 6 WHEN 0 THEN ' University of'
          WHEN 1 THEN ' worked as a' WHEN 2 THEN ' GPA 3.1' WHEN 3 THEN ' Date of birth' ELSE '' END) AS u,
        CASE WHEN doc_id % 5 = 0 THEN 1.5e0 ELSE 1.4e0 END AS aspect FROM documents)
    SELECT id, CASE
      WHEN contains(u, 'DEGREE') OR contains(u, 'UNIVERSITY') OR contains(u, 'BACHELOR')
        OR contains(u, 'MASTER') THEN 'degree_certificate'
      WHEN contains(u, 'EMPLOYMENT') OR contains(u, 'EXPERIENCE CERTIFICATE')
        OR contains(u, 'WORKED AS') THEN 'employment_certificate'
      WHEN contains(u, 'TRANSCRIPT') OR contains(u, 'GRADE') OR contains(u, 'GPA')
        OR contains(u, 'SEMESTER') THEN 'transcript'
      WHEN contains(u, 'PASSPORT') OR contains(u, 'IDENTITY CARD') OR contains(u, 'DATE OF BIRTH')
        OR contains(u, 'NATIONALITY') THEN 'identity_document'
      WHEN aspect > 1.4e0 THEN 'identity_document' ELSE 'generic_document' END AS doc_type
    FROM texts""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    extra = F.lit("")
    for rest, words in _WORDS:
        extra = F.when(F.col("doc_id") % 6 == rest, words).otherwise(extra)
    aspect = F.when(F.col("doc_id") % 5 == 0, 1.5).otherwise(1.4)
    return docs.select(
        F.col("doc_id").alias("id"),
        tx.classify_doc_type(F.concat("text", extra), aspect).alias("doc_type"),
    )


# --- scope, samples and splits ----------------------------------------------------------------

_PREFIXES = ("alb", "AZE", "esp", "est", "fin", "lva", "svk", "grc", "rus", "srb", "ita", "")


def strata(spark, folder) -> DataFrame:
    """Customers as OCR records: document type by nation, capture in the id by key."""
    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    capture = F.when(key % 3 == 0, "scan").when(key % 3 == 1, "photo").otherwise("other")
    prefix = F.get(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("c_nationkey") % 12).cast("int"))
    return customer.select(
        F.concat(F.lit("ocr_"), capture, F.lit("_"), key.cast("string")).alias("id"),
        key.alias("row_index"),
        F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit("_id"))).alias("doc_type"),
        F.when(key % 7 == 0, "Latin").alias("script"),
        F.format_string("n%02d", "c_nationkey").alias("country"),
        sampling.capture_kind(F.concat(F.lit("ocr_"), capture)).alias("capture"),
        (key % 2).cast("int").alias("label"),
    )


STRATA = """
fx_strata AS (
  SELECT 'ocr_' || capture || '_' || c_custkey AS id, c_custkey AS row_index,
    CASE WHEN prefix = '' THEN '' ELSE prefix || '_id' END AS doc_type,
    CASE WHEN c_custkey % 7 = 0 THEN 'Latin' END AS script,
    printf('n%02d', c_nationkey) AS country, capture, (c_custkey % 2)::INTEGER AS label
  FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'photo' ELSE 'other' END AS capture,
          ['alb','AZE','esp','est','fin','lva','svk','grc','rus','srb','ita',''][c_nationkey % 12 + 1]
          AS prefix FROM customer))"""

_SCOPED = STRATA + """,
scoped AS (
  SELECT *, CASE WHEN lower(split_part(doc_type, '_', 1)) IN
      ('alb','aze','esp','est','fin','lva','svk','grc','rus','srb')
    THEN lower(split_part(doc_type, '_', 1)) END AS c FROM fx_strata),
named AS (
  SELECT *, CASE WHEN c = 'grc' THEN 'greek' WHEN c IN ('rus', 'srb') THEN 'cyrillic'
                 WHEN c IS NOT NULL THEN 'latin' END AS s FROM scoped)"""


@query(
    "country_script",
    f"""WITH {_SCOPED} SELECT id, c AS country_code, s AS doc_script,
      CASE c WHEN 'grc' THEN 'el' WHEN 'rus' THEN 'ru' ELSE 'en' END AS lang FROM named""",
)
def _(spark, folder):
    country = tx.country_of(F.col("doc_type"))
    return strata(spark, folder).select(
        "id",
        country.alias("country_code"),
        tx.script_of(F.col("doc_type")).alias("doc_script"),
        tx.lang_used(country, {"grc": "el", "rus": "ru"}).alias("lang"),
    )


@query(
    "scope_filter",
    f"""WITH {_SCOPED} SELECT id, doc_type FROM named
    WHERE lower(coalesce(script, s, 'unknown')) = 'latin'
      AND coalesce(c, 'unknown') IN ('alb', 'aze', 'esp', 'unknown', 'rus')""",
)
def _(spark, folder):
    kept = cer_ops.scope_filter(
        strata(spark, folder), ["LATIN"], ["alb", "AZE", "esp", "Unknown", "rus"]
    )
    return kept.select("id", "doc_type")


@query(
    "stratified_sample",
    f"""WITH {STRATA}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY country, capture ORDER BY md5('42:' || id), id) AS k
      FROM fx_strata),
    turns AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY
        CASE WHEN capture IN ('scan', 'photo') THEN 0 ELSE 1 END, k,
        CASE WHEN capture = 'scan' THEN 0 ELSE 1 END, id) AS turn FROM ranked),
    quotas AS (SELECT country, 110 // count(*) OVER () + CASE WHEN
        row_number() OVER (ORDER BY country) <= 110 % count(*) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT DISTINCT country FROM fx_strata))
    SELECT id, country, capture FROM turns JOIN quotas USING (country) WHERE turn <= quota""",
)
def _(spark, folder):
    picked = sampling.stratified_sample(strata(spark, folder), 110, 42)
    return picked.select("id", "country", "capture")


@query(
    "legacy_sample",
    f"""WITH {STRATA}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY capture ORDER BY row_index) AS place FROM fx_strata)
    SELECT id, capture FROM placed WHERE (capture = 'scan' AND place <= 45)
      OR (capture = 'photo' AND place <= 46)""",
)
def _(spark, folder):
    return sampling.legacy_sample(strata(spark, folder), 91).select("id", "capture")


@query(
    "balanced_eval_sample",
    f"""WITH {STRATA} SELECT id, label FROM fx_strata
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) <= 60""",
)
def _(spark, folder):
    return sampling.balanced_eval_sample(strata(spark, folder), 121, 7).select("id", "label")


def split(spark, folder) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    return sampling.holdout_split(names, "name", 80, 40, 42)


SPLIT = """
fx_split AS (
  SELECT c_name AS name, CASE WHEN r <= 80 THEN 'train' ELSE 'eval' END AS side, 42 AS seed
  FROM (SELECT c_name, row_number() OVER (ORDER BY md5('42:' || c_name), c_name) AS r FROM customer)
  WHERE r <= 120)"""


@query("holdout_split", f"WITH {SPLIT} SELECT * FROM fx_split")
def _(spark, folder):
    return split(spark, folder)


@query(
    "seeded_order",
    """SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus
       ORDER BY md5('9:' || o_orderkey), o_orderkey) AS "rank" FROM orders""",
)
def _(spark, folder):
    from tallymark.operators.ordering import seeded_rank

    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")
    )
    return seeded_rank(orders, "id", 9, ["status"]).select("id", "rank")


@query(
    "split_overlap",
    f"""WITH {SPLIT}, other AS (SELECT c_name AS name FROM customer
      QUALIFY row_number() OVER (ORDER BY md5('43:' || c_name), c_name) <= 800)
    SELECT name FROM fx_split WHERE side = 'train' INTERSECT SELECT name FROM other""",
)
def _(spark, folder):
    from tallymark.operators.ordering import seeded_top

    names = table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    other = seeded_top(names, "name", 43, 800).select("name", F.lit("eval").alias("side"))
    train = split(spark, folder).where(F.col("side") == "train").select("name", "side")
    return splits.split_overlap(train.unionByName(other))


@query(
    "holdout_train_filter",
    f"""WITH {SPLIT} SELECT c_name AS name, c_nationkey FROM customer
    WHERE c_name IN (SELECT name FROM fx_split WHERE side = 'train') AND c_mktsegment <> 'MACHINERY'""",
)
def _(spark, folder):
    files = table(spark, folder, "customer").where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_name").alias("name"), "c_nationkey"
    )
    return splits.holdout_train_filter(files, split(spark, folder))


@query(
    "missing_train_names",
    f"""WITH {SPLIT} SELECT name FROM fx_split WHERE side = 'train'
    AND name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment <> 'MACHINERY')""",
)
def _(spark, folder):
    files = table(spark, folder, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    return splits.missing_train_names(
        files.select(F.col("c_name").alias("name")), split(spark, folder)
    )


@query(
    "train_minus_eval",
    """SELECT s_name AS path, false AS fallback FROM supplier WHERE s_nationkey >= 8""",
)
def _(spark, folder):
    supplier = table(spark, folder, "supplier")
    evaluation = supplier.select(
        F.col("s_name").alias("path"), F.when(F.col("s_nationkey") < 8, 0).otherwise(1).alias("label")
    )
    return splits.train_minus_eval(supplier.select(F.col("s_name").alias("path")), evaluation)


@query(
    "train_minus_eval_fallback",
    """SELECT s_name AS path, true AS fallback FROM supplier
    QUALIFY row_number() OVER (ORDER BY md5('17101:' || s_name), s_name) <= count(*) OVER () // 2""",
)
def _(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_name").alias("path"))
    return splits.train_minus_eval(names, names.withColumn("label", F.lit(0)))


def dual(spark, folder) -> DataFrame:
    customer = table(spark, folder, "customer")
    supplier = table(spark, folder, "supplier")
    in_debt = F.col("c_acctbal") < 0
    generated = customer.where(in_debt).select(
        F.concat(F.lit("gen/"), "c_name").alias("path"),
        F.when(F.col("c_nationkey") < 12, F.concat(F.lit("masks/"), "c_name")).alias("mask_path"),
    )
    return splits.dual_domain_manifest(
        customer.where(~in_debt).select(F.concat(F.lit("auth/"), "c_name").alias("path")),
        generated,
        supplier.select(F.concat(F.lit("third/"), "s_name").alias("path")),
        caps=(200, None, 500),
    )


DUAL = """
auth AS (SELECT path, row_number() OVER (ORDER BY path) AS i FROM
  (SELECT 'auth/' || c_name AS path FROM customer WHERE c_acctbal >= 0) QUALIFY i <= 200),
gen AS (SELECT path, mask_path, row_number() OVER (ORDER BY path) AS i FROM
  (SELECT 'gen/' || c_name AS path, CASE WHEN c_nationkey < 12 THEN 'masks/' || c_name END AS mask_path
   FROM customer WHERE c_acctbal < 0)),
third AS (SELECT path, row_number() OVER (ORDER BY path) AS i FROM
  (SELECT 'third/' || s_name AS path FROM supplier) QUALIFY i <= 500),
dual AS (
  SELECT 'auth_' || d || '_' || printf('%05d', i) AS id, path, 0 AS label, 'public_dataset' AS origin,
    'authentic' AS fabrication, NULL AS tamper, NULL AS mask_path, d AS eval_domain,
    'authentic' AS generator FROM auth, (VALUES ('in_domain'), ('cross_domain')) v(d)
  UNION ALL
  SELECT 'fg_in_' || printf('%05d', i), path, 1, 'synthetic_generated', 'script', 'mixed',
    coalesce(mask_path, path), 'in_domain', 'generated' FROM gen
  UNION ALL
  SELECT 'fg_xd_' || printf('%05d', i), path, 1, 'public_dataset', 'script', 'copy_move', path,
    'cross_domain', 'third_party' FROM third)"""


@query("dual_domain_manifest", f"WITH {DUAL} SELECT * FROM dual")
def _(spark, folder):
    return dual(spark, folder)


@query(
    "split_counts",
    f"""WITH {DUAL} SELECT count(*) AS total, count(*) FILTER (WHERE eval_domain = 'in_domain') AS in_domain,
      count(*) FILTER (WHERE eval_domain = 'cross_domain') AS cross_domain,
      count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1
    FROM dual""",
)
def _(spark, folder):
    return splits.split_counts(dual(spark, folder))


@query(
    "capped_inputs",
    """SELECT * FROM (SELECT 'authentic' AS pool, row_number() OVER (ORDER BY c_name) AS position, c_name AS path
      FROM customer QUALIFY position <= 200)
    UNION ALL SELECT 'forged', row_number() OVER (ORDER BY s_name), s_name FROM supplier""",
)
def _(spark, folder):
    return sampling.capped_inputs(
        {
            "authentic": (table(spark, folder, "customer").select(F.col("c_name").alias("path")), 200),
            "forged": (table(spark, folder, "supplier").select(F.col("s_name").alias("path")), None),
        }
    )


@query(
    "authentic_pick",
    """WITH picked AS (SELECT p_partkey || '.jpg' AS source_path, row_number() OVER
      (ORDER BY md5('42:' || p_partkey || '.jpg'), p_partkey || '.jpg') AS i FROM part QUALIFY i <= 500)
    SELECT 'auth_' || printf('%04d', i) AS id, source_path, 0 AS label, 'authentic' AS fabrication,
      'public_dataset' AS origin FROM picked
    UNION ALL SELECT 'fg_' || printf('%04d', i), source_path, 1, 'script', 'synthetic_generated'
    FROM picked""",
)
def _(spark, folder):
    images = table(spark, folder, "part").select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path")
    )
    return sampling.authentic_pick(images, 500, 42, check=False)


@query(
    "train_pool",
    """SELECT 'authentic' AS pool, c_name AS path, NULL AS mask_path, 0 AS label FROM customer
    UNION ALL SELECT 'easy', p_name || p_partkey, 'm' || p_partkey, 1 FROM part WHERE p_size > 25
    UNION ALL SELECT 'hard', s_name, 'm' || s_suppkey, 1 FROM supplier WHERE s_acctbal > 0""",
)
def _(spark, folder):
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    easy = part.select(
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("mask_path"),
        (F.col("p_size") > 25).cast("int").alias("label"),
    )
    hard = supplier.select(
        F.col("s_name").alias("path"),
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("mask_path"),
        (F.col("s_acctbal") > 0).cast("int").alias("label"),
    )
    authentic = table(spark, folder, "customer")
    return splits.train_pool_assembly(
        authentic.select(F.col("c_name").alias("path")), {"easy": easy, "test": easy, "hard": hard}
    )


@query(
    "eval_manifest",
    f"""WITH {SPLIT}, held AS (SELECT name || '.jpg' AS name FROM fx_split WHERE side = 'eval')
    SELECT regexp_replace(name, '\\.jpg$', '') AS id, 'authentic/' || name AS path, 0 AS label,
      'public_dataset' AS origin, 'authentic' AS fabrication, NULL AS tamper, NULL AS mask_path,
      NULL AS source FROM held
    UNION ALL
    SELECT 'fg_' || regexp_replace(name, '\\.jpg$', ''), 'images/fg_' || regexp_replace(name, '\\.jpg$', '') || '.png',
      1, 'synthetic_generated', 'script', 'splice', 'masks/fg_' || regexp_replace(name, '\\.jpg$', '')
      || '_mask.png', name FROM held""",
)
def _(spark, folder):
    held = split(spark, folder).where(F.col("side") == "eval").select(
        F.concat("name", F.lit(".jpg")).alias("name")
    )
    forged = held.select(
        F.concat(F.lit("out/"), "name", F.lit("x.PNG")).alias("path"),
        F.lit("splice").alias("tamper"),
        F.col("name").alias("source"),
    )
    return splits.holdout_eval_manifest(held, forged)


@query(
    "manifest_merge",
    """SELECT c_name AS id, 0 AS label, NULL AS tamper FROM customer
    UNION ALL SELECT s_name, 1, 'splice' FROM supplier""",
)
def _(spark, folder):
    return splits.manifest_merge(
        table(spark, folder, "customer").select(F.col("c_name").alias("id"), F.lit(0).alias("label")),
        table(spark, folder, "supplier").select(
            F.col("s_name").alias("id"), F.lit(1).alias("label"), F.lit("splice").alias("tamper")
        ),
    )


# --- manifests and provenance -----------------------------------------------------------------


def manifest(spark, folder) -> DataFrame:
    """Documents as forgery records: origin, fabrication, tamper and mask by key."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    key = F.col("doc_id")
    origins = ("dev_fixture", "public_dataset", "synthetic_generated", " field_collected ", "  ")
    made = ("authentic", "script", "manual", "authentic", None, "weird", "script")
    origin = F.get(F.array(*[F.lit(o) for o in origins]), (key % 5).cast("int"))
    fabrication = F.get(F.array(*[F.lit(m).cast("string") for m in made]), (key % 7).cast("int"))
    name = F.concat(F.lit("img/"), key.cast("string"), F.lit(".jpg"))
    return docs.join(labels, "doc_id", "left").select(
        key.alias("id"),
        "lang",
        F.col("source").alias("manifest"),
        F.col("quality").alias("label"),
        origin.alias("origin"),
        fabrication.alias("fabrication"),
        F.when(key % 3 != 0, "splice").alias("tamper"),
        name.alias("path"),
        F.when(key % 4 != 0, F.concat(F.lit("masks/"), key.cast("string"))).alias("mask_path"),
    )


MANIFEST = """
fx_manifest AS (
  SELECT doc_id AS id, lang, source AS manifest, quality AS label,
    ['dev_fixture', 'public_dataset', 'synthetic_generated', ' field_collected ', '  '][doc_id % 5 + 1] AS origin,
    ['authentic', 'script', 'manual', 'authentic', NULL, 'weird', 'script'][doc_id % 7 + 1] AS fabrication,
    CASE WHEN doc_id % 3 <> 0 THEN 'splice' END AS tamper, 'img/' || doc_id || '.jpg' AS path,
    CASE WHEN doc_id % 4 <> 0 THEN 'masks/' || doc_id END AS mask_path
  FROM documents LEFT JOIN labels USING (doc_id)),
origins AS (SELECT *, nullif(trim(origin), '') AS o FROM fx_manifest)"""


@query(
    "forgery_row_rules",
    f"""WITH {MANIFEST} SELECT id, rule FROM (
      SELECT id, unnest([
        CASE WHEN label IS NULL OR label NOT IN (0, 1) THEN 'label_not_binary' END,
        CASE WHEN fabrication IS NULL THEN 'fabrication_missing' END,
        CASE WHEN fabrication NOT IN ('authentic', 'script', 'manual') THEN 'fabrication_unknown' END,
        CASE WHEN label = 0 AND fabrication <> 'authentic' THEN 'authentic_label_mismatch' END,
        CASE WHEN label = 1 AND fabrication = 'authentic' THEN 'forged_label_mismatch' END,
        CASE WHEN label = 1 AND tamper IS NULL THEN 'tamper_missing' END,
        CASE WHEN label = 1 AND mask_path IS NULL THEN 'mask_missing' END]) AS rule
      FROM fx_manifest) WHERE rule IS NOT NULL""",
)
def _(spark, folder):
    return validation.forgery_row_rules(manifest(spark, folder))


@query(
    "legacy_migration",
    """WITH old AS (
      SELECT doc_id AS id, quality AS label, ['authentic', 'script', 'manual', 'dev_fixture',
          'field_collected', 'elsewhere'][doc_id % 6 + 1] AS origin,
        CASE WHEN doc_id % 4 = 0 THEN 'manual' END AS fabrication
      FROM documents LEFT JOIN labels USING (doc_id))
    SELECT id, label,
      CASE WHEN fabrication IS NULL AND origin = 'authentic' THEN 'dev_fixture'
           WHEN fabrication IS NULL AND origin IN ('script', 'manual') THEN 'synthetic_generated'
           ELSE origin END AS origin,
      CASE WHEN fabrication IS NOT NULL THEN fabrication
           WHEN origin IN ('authentic', 'script', 'manual') THEN origin
           WHEN origin IN ('dev_fixture', 'field_collected') AND label = 0 THEN 'authentic'
           WHEN origin IN ('dev_fixture', 'field_collected') AND label = 1 THEN 'script'
           END AS fabrication FROM old""",
)
def _(spark, folder):
    origins = ("authentic", "script", "manual", "dev_fixture", "field_collected", "elsewhere")
    key = F.col("doc_id")
    docs = table(spark, folder, "documents").select("doc_id").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    old = docs.select(
        key.alias("id"),
        F.col("quality").alias("label"),
        F.get(F.array(*[F.lit(o) for o in origins]), (key % 6).cast("int")).alias("origin"),
        F.when(key % 4 == 0, "manual").alias("fabrication"),
    )
    return provenance.forgery_migrate_legacy(old)


@query(
    "origin_distribution",
    f"""WITH {MANIFEST} SELECT lang, coalesce(o, 'unknown') AS origin, count(*) AS n FROM origins
    GROUP BY ALL""",
)
def _(spark, folder):
    return provenance.origin_distribution(manifest(spark, folder), ["lang"])


@query(
    "trial_valid",
    f"""WITH {MANIFEST} SELECT id % 10 AS part,
      bool_and(coalesce(o = 'field_collected', false)) AS trial_valid FROM origins GROUP BY ALL""",
)
def _(spark, folder):
    parted = manifest(spark, folder).withColumn("part", F.col("id") % 10)
    return provenance.trial_valid(parted, ["part"])


@query(
    "origin_rules",
    f"""WITH {MANIFEST} SELECT id % 20 AS part, CASE WHEN bool_or(o = 'dev_fixture') THEN 'dev_fixture'
      WHEN bool_or(o = 'public_dataset') THEN 'public_dataset'
      WHEN bool_or(o = 'synthetic_generated') THEN 'synthetic_generated' END AS banner_origin
    FROM origins GROUP BY ALL""",
)
def _(spark, folder):
    parted = manifest(spark, folder).withColumn("part", F.col("id") % 20)
    return provenance.most_severe_origin(parted, ["part"])


@query(
    "banner_across_results",
    f"""WITH {MANIFEST} SELECT CASE WHEN bool_or(o = 'public_dataset') THEN 'public_dataset'
      WHEN bool_or(o = 'synthetic_generated') THEN 'synthetic_generated' END AS banner
    FROM origins WHERE coalesce(o, '') <> 'dev_fixture'""",
)
def _(spark, folder):
    rows = manifest(spark, folder).where(F.col("origin") != "dev_fixture")
    counted = provenance.origin_distribution(rows, ["lang"])
    valid = provenance.trial_valid(rows, ["lang"])
    return provenance.most_severe_across(counted.join(valid, "lang"))


@query(
    "has_dev_fixture",
    f"""WITH {MANIFEST} SELECT bool_or(origin = 'dev_fixture') AS has_dev_fixture FROM fx_manifest""",
)
def _(spark, folder):
    return provenance.has_dev_fixture(manifest(spark, folder))


@query(
    "non_trial_manifests",
    f"""WITH {MANIFEST} SELECT DISTINCT manifest FROM fx_manifest
    WHERE origin IN ('dev_fixture', 'public_dataset', 'synthetic_generated')""",
)
def _(spark, folder):
    return provenance.non_trial_manifests(manifest(spark, folder))


@query(
    "non_field_origins",
    f"""WITH {MANIFEST} SELECT DISTINCT coalesce(o, 'unknown') AS origin FROM origins
    WHERE coalesce(o, 'unknown') <> 'field_collected'""",
)
def _(spark, folder):
    trimmed = provenance.origin_normalize(F.col("origin"))
    return provenance.non_field_origins(manifest(spark, folder).withColumn("origin", trimmed))


@query(
    "missing_paths",
    f"""WITH {MANIFEST} SELECT id, 'path' AS "column", path FROM fx_manifest WHERE lang = 'fr'
    UNION ALL SELECT id, 'mask_path', mask_path FROM fx_manifest
      WHERE mask_path IS NOT NULL AND lang <> 'en'""",
)
def _(spark, folder):
    rows = manifest(spark, folder)
    key = F.col("doc_id").cast("string")
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    images = docs.where(F.col("lang") != "fr").select(
        F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("rel_path")
    )
    masks = docs.where(F.col("lang") == "en").select(F.concat(F.lit("masks/"), key).alias("rel_path"))
    return validation.missing_paths(rows, images.unionByName(masks), ["path", "mask_path"])


@query(
    "expected_counts",
    """WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE quality = 0) AS label_0 FROM labels)
    SELECT 'total' AS name, 1::BIGINT AS expected, total AS actual FROM c
    UNION ALL SELECT 'label_0', 2, label_0 FROM c WHERE label_0 <> 2""",
)
def _(spark, folder):
    rows = table(spark, folder, "labels").withColumn("origin", F.lit("field_collected"))
    label = F.col("quality")
    return validation.expected_counts(
        rows, {"total": 1, "label_0": 2}, {"label_0": label == 0, "label_1": label == 1}
    )


# --- scores and responses ---------------------------------------------------------------------


@query(
    "score_join",
    """SELECT o_orderkey AS id, o_orderstatus AS domain, o_totalprice / 500000e0 AS score
    FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    records = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("domain"))
    scored = orders.where(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000.0).alias("score")
    )
    return validation.score_join(records, scored)


@query(
    "unscored",
    """SELECT o_orderkey AS id, 'no score' AS reason FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT o_orderkey, 'timeout' FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    scored = orders.where(F.col("o_orderpriority") != "5-LOW").withColumn(
        "error", F.when(F.col("o_orderpriority") == "1-URGENT", "timeout")
    )
    return validation.unscored(orders, scored)


@query(
    "response_contract",
    """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 1 THEN 'missing_fields' WHEN 2 THEN 'missing_score'
      WHEN 3 THEN 'null_value' WHEN 4 THEN 'not_numeric' END AS rule
    FROM orders WHERE o_orderkey % 9 BETWEEN 1 AND 4""",
)
def _(spark, folder):
    kind = F.col("o_orderkey") % 9
    text = F.lit(None).cast("string")
    fields, score = F.lit("fields"), F.lit("score")
    value = F.when(kind == 3, text).when(kind == 4, F.lit("high")).otherwise(
        F.col("o_totalprice").cast("string")
    )
    response = (
        F.when(kind == 1, F.create_map(score, value))
        .when(kind == 2, F.create_map(fields, F.lit("{}")))
        .otherwise(F.create_map(fields, F.lit("{}"), score, value))
    )
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), response.alias("response")
    )
    return validation.response_contract(rows, ["fields"], "score")
