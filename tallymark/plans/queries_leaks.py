"""Overlap of training and evaluation sides, and dataset digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.documents import base_name, document_key
from tallymark.operators import fingerprint, leakage, sampling
from tallymark.plans.catalog import query, table
from tallymark.plans.leakcheck import check_leakage
from tallymark.session import materialize


def sides(spark, folder, reread: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents dealt to training (even) and evaluation (odd), with the digest of their text.

    With ``reread`` the index is written once, as the texts are far larger than their digests.
    """
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"),
        F.concat_ws("/", F.col("lang"), F.floor(F.col("n_chars") / 1000).cast("string")).alias("source_id"),
        (F.col("doc_id") % 2 == 0).alias("in_train"),
    )
    docs = materialize(docs) if reread else docs
    return docs.where("in_train").drop("in_train"), docs.where("NOT in_train").drop("in_train")


SIDES = """
docs AS (
  SELECT 'doc_' || doc_id AS path, sha256(text) AS sha256, lang || '/' || n_chars // 1000 AS source_id,
         doc_id % 2 = 0 AS in_train FROM documents),
train AS (SELECT * FROM docs WHERE in_train),
evals AS (SELECT * FROM docs WHERE NOT in_train)"""


def shared_sql(key: str, train: str = "train", evals: str = "evals") -> str:
    return f"""(
      SELECT * FROM (SELECT {key}, count(*) AS n_eval, min(path) AS first_eval_path FROM {evals} GROUP BY {key})
      JOIN (SELECT {key}, count(*) AS n_train, min(path) AS first_train_path FROM {train} GROUP BY {key})
      USING ({key}))"""


@query("leak_exact", f"WITH {SIDES} SELECT * FROM {shared_sql('sha256')}")
def _(spark, folder):
    return leakage.leak_exact(*sides(spark, folder))


@query(
    "leak_exact_rows",
    f"""WITH {SIDES} SELECT path, sha256, n_train, first_train_path
    FROM evals JOIN {shared_sql('sha256')} USING (sha256)""",
)
def _(spark, folder):
    return leakage.leak_exact_rows(*sides(spark, folder, reread=True))


@query(
    "leak_train_members",
    f"""WITH {SIDES} SELECT path, sha256, source_id FROM train
    WHERE sha256 IN (SELECT sha256 FROM evals)""",
)
def _(spark, folder):
    train, evaluation = sides(spark, folder, reread=True)
    found = leakage.leak_exact(train, evaluation)
    return leakage.leak_members(train, found, "sha256", "n_train")


@query("leak_source", f"WITH {SIDES} SELECT * FROM {shared_sql('source_id')}")
def _(spark, folder):
    return leakage.leak_source(*sides(spark, folder))


@query(
    "leak_top50",
    f"""WITH {SIDES} SELECT * FROM {shared_sql('sha256')} ORDER BY first_eval_path LIMIT 50""",
)
def _(spark, folder):
    return sampling.top_samples(leakage.leak_exact(*sides(spark, folder)), ["first_eval_path"])


def hashes(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A sign bit for each element of a vector; the evaluation side has up to eleven low bits flipped."""
    bits = F.aggregate(
        F.transform(
            "embedding",
            lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
                F.lit(0).cast("bigint")
            ),
        ),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc.bitwiseOR(b),
    )
    vectors = materialize(table(spark, folder, "embeddings").select("vec_id", bits.alias("fp")))
    key = F.col("vec_id").cast("string")
    flipped = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("vec_id") % 12).cast("int")) - 1
    train = vectors.select(F.concat(F.lit("t"), key).alias("path"), F.col("fp").alias("phash"))
    evaluation = vectors.select(
        F.concat(F.lit("e"), key).alias("path"), F.col("fp").bitwiseXOR(flipped).alias("phash")
    )
    return train, evaluation


HASHES = """
fps AS (
  SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x <= 0 THEN 0::BIGINT
      WHEN i = 64 THEN -9223372036854775808 ELSE 1::BIGINT << (i - 1) END), lambda a, b: a | b) AS fp
  FROM embeddings),
train AS (SELECT 't' || vec_id AS path, fp AS phash FROM fps),
evals AS (SELECT 'e' || vec_id AS path, xor(fp, (1::BIGINT << (vec_id % 12)::INTEGER) - 1) AS phash FROM fps),
near AS (
  SELECT e.phash AS eval_hash, t.phash AS train_hash, bit_count(xor(e.phash, t.phash))::INTEGER AS hamming_distance,
         n_eval, n_train, first_eval_path, first_train_path
  FROM (SELECT phash, count(*) AS n_eval, min(path) AS first_eval_path FROM evals GROUP BY phash) e,
       (SELECT phash, count(*) AS n_train, min(path) AS first_train_path FROM train GROUP BY phash) t
  WHERE bit_count(xor(e.phash, t.phash)) <= 6)"""


@query("leak_near", f"WITH {HASHES} SELECT * FROM near")
def near(spark, folder):
    return leakage.near_hash_pairs(*hashes(spark, folder))


@query(
    "near_pair_count",
    f"WITH {HASHES} SELECT sum(n_eval * n_train)::BIGINT AS near_duplicate_count FROM near",
)
def _(spark, folder):
    return leakage.near_pair_count(near(spark, folder))


@query(
    "near_rows",
    f"""WITH {HASHES} SELECT path, phash, sum(n_train)::BIGINT AS n_train,
      min(hamming_distance) AS min_distance,
      arg_min(first_train_path, printf('%02d', hamming_distance) || first_train_path) AS nearest_train_path
    FROM evals JOIN near ON phash = eval_hash GROUP BY path, phash""",
)
def _(spark, folder):
    train, evaluation = hashes(spark, folder)
    return leakage.near_rows(evaluation, leakage.near_hash_pairs(train, evaluation))


def crowded_hashes(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Hashes of orders on both sides; a third of each side lies within five bits of one hash."""
    number = F.col("o_orderkey").cast("string")

    def hashed(text, first: int = 1, length: int = 15):
        return F.conv(F.substring(F.md5(text), first, length), 16, 10).cast("bigint")

    flips = F.lit(0x0F0F_3C3C_5A5A_7711).cast("bigint")
    for i in range(5):
        place = (hashed(number, 1 + 2 * i, 2) % 63).cast("int")
        flips = flips.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("o"), number).alias("path"),
        F.when(hashed(number, 1, 8) % 3 == 0, flips).otherwise(hashed(number)).alias("phash"),
        (F.col("o_custkey") % 2 == 0).alias("in_train"),
    )
    return rows.where("in_train").drop("in_train"), rows.where("NOT in_train").drop("in_train")


@query(
    "leak_near_crowded",
    """WITH h AS (
      SELECT o_orderkey::VARCHAR AS k, o_custkey % 2 = 0 AS in_train, md5(o_orderkey::VARCHAR) AS m FROM orders),
    hashes AS (
      SELECT 'o' || k AS path, in_train, CASE WHEN ('0x' || m[1:8])::BIGINT % 3 = 0
        THEN list_reduce([1085152265131161361::BIGINT] || [1::BIGINT << (('0x' || m[2 * i + 1 : 2 * i + 2])::INTEGER % 63)
          FOR i IN range(5)], lambda a, b: xor(a, b))
        ELSE ('0x' || m[1:15])::BIGINT END AS phash FROM h)
    SELECT e.phash AS eval_hash, t.phash AS train_hash, bit_count(xor(e.phash, t.phash))::INTEGER AS hamming_distance,
      n_eval, n_train, first_eval_path, first_train_path
    FROM (SELECT phash, count(*) AS n_eval, min(path) AS first_eval_path FROM hashes WHERE NOT in_train GROUP BY phash) e
    JOIN (SELECT phash, count(*) AS n_train, min(path) AS first_train_path FROM hashes WHERE in_train GROUP BY phash) t
      ON bit_count(xor(e.phash, t.phash)) <= 4""",
)
def _(spark, folder):
    train, evaluation = crowded_hashes(spark, folder)
    return leakage.near_hash_pairs(train, evaluation, distance=4, bands=6, crowded=1 << 12)


# --- the whole check --------------------------------------------------------------------------


def listed_files(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every document as a training file and as an evaluation file, with what each leak would show.

    The columns ``same_*`` and ``other_*`` are digests, hashes and paths that leak and that do not.
    """
    number = F.format_string("%07d", "doc_id")

    def hashed(text):
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    docs = materialize(
        table(spark, folder, "documents").select(
            "doc_id", number.alias("number"), F.sha2("text", 256).alias("same_digest"),
            F.sha2(F.concat("text", F.lit("#")), 256).alias("other_digest"),
            hashed(number).alias("hash"),
            hashed(F.concat(F.lit("other"), number)).alias("other_hash"),
        )
    )
    flipped = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("doc_id") % 12).cast("int")) - 1
    train = docs.select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("masks/fg_auth_"), "number", F.lit(".png")))
        .otherwise(F.concat(F.lit("images/fg_auth_"), "number", F.lit(".PNG"))).alias("path"),
        F.col("same_digest").alias("sha256"),
        F.col("hash").alias("phash"),
    )
    evaluation = docs.select(
        F.concat(F.lit("authentic/auth_"), "number", F.lit(".jpg")).alias("same_path"),
        F.concat(F.lit("authentic/new_"), "number", F.lit(".jpg")).alias("other_path"),
        "same_digest",
        "other_digest",
        F.col("hash").bitwiseXOR(flipped).alias("same_hash"),
        "other_hash",
        "number",
        (F.col("doc_id") % 3 == 0).alias("held_back"),
    )
    return train, evaluation


# What leaks in each case: (path, digest, hash), and whether the split names a file on both sides.
LEAK_CASES = {
    "names": ("other", "other", "other", True),
    "exact": ("other", "same", "other", False),
    "near": ("other", "other", "same", False),
    "source": ("same", "other", "other", False),
    "none": ("other", "other", "other", False),
}


def _leak_case_sql(case: str) -> str:
    path, digest, hashed, both = LEAK_CASES[case]
    stem = "auth" if path == "same" else "new"
    return f"""(
      WITH t AS (SELECT 'auth_' || number AS source_id, same_digest AS d, hash AS h FROM files WHERE doc_id % 11 <> 0),
      e AS (SELECT '{stem}_' || number AS source_id, {digest}_digest AS d,
              {'xor(hash, (1::BIGINT << (doc_id % 12)::INTEGER) - 1)' if hashed == 'same' else 'other_hash'} AS h
            FROM files WHERE doc_id % 3 <> 0),
      counts AS (SELECT '{case}' AS leak, (SELECT count(*) FROM t) AS n_train_files, (SELECT count(*) FROM e) AS n_eval_files,
        (SELECT count(source_id) FROM t) AS n_train_with_source_id, (SELECT count(source_id) FROM e) AS n_eval_with_source_id,
        {"(SELECT count(*) FROM files WHERE doc_id % 3 = 0)" if both else "0::BIGINT"} AS name_overlap_count,
        (SELECT count(*) FROM e WHERE d IN (SELECT d FROM t)) AS exact_duplicate_count,
        (SELECT count(*) FROM e JOIN t ON bit_count(xor(e.h, t.h)) <= 6) AS near_duplicate_count,
        (SELECT count(*) FROM (SELECT DISTINCT source_id FROM e) WHERE source_id IN (SELECT source_id FROM t))
          AS source_id_overlap_count)
      SELECT *, CASE WHEN name_overlap_count + exact_duplicate_count + near_duplicate_count > 0 THEN 'FAIL'
        WHEN source_id_overlap_count > 0 THEN 'CHECK' ELSE 'PASS' END AS verdict FROM counts)"""


@query(
    "leak_verdict",
    f"""WITH files AS (
      SELECT doc_id, printf('%07d', doc_id) AS number, sha256(text) AS same_digest, sha256(text || '#') AS other_digest,
        ('0x' || md5(printf('%07d', doc_id))[1:15])::BIGINT AS hash,
        ('0x' || md5('other' || printf('%07d', doc_id))[1:15])::BIGINT AS other_hash FROM documents)
    {' UNION ALL '.join('SELECT * FROM ' + _leak_case_sql(case) for case in LEAK_CASES)}""",
)
def _(spark, folder):
    train, evaluation = listed_files(spark, folder)
    forged = train.select("path", F.lit(None).cast("string").alias("source"), F.lit(1).alias("label"))
    reports = []
    for case, (path, digest, hashed, both) in LEAK_CASES.items():
        files = evaluation.select(
            F.col(f"{path}_path").alias("path"),
            F.col(f"{digest}_digest").alias("sha256"),
            F.col(f"{hashed}_hash").alias("phash"),
            "held_back",
        )
        names = files.select(base_name(F.col("path")).alias("name"), "held_back")
        held = names.where("held_back").select("name", F.lit("train").alias("side"))
        split = held.unionByName(
            names.where(F.lit(both) | ~F.col("held_back")).select("name", F.lit("eval").alias("side"))
        )
        # A name on both sides may be evaluated, as the split says so; its file is left out here.
        files = files.where(~F.col("held_back")).drop("held_back")
        checked = check_leakage(train, files, forged, split=split)
        reports.append(checked.report.select(F.lit(case).alias("leak"), "*"))
    return reduce(DataFrame.unionByName, reports)


def _tree(name: str, entries: str) -> str:
    """The digest tree over (name, digest) rows: eight leading hex digits of md5(name), two a level."""
    hashed = "sha256(string_agg({0} || chr(0) || {1} || chr(0), '' ORDER BY {0})) AS hash"
    level = f"""(SELECT md5(name)[1:8] AS bucket, {hashed.format('name', 'digest')}, count(*) AS n
      FROM {entries} GROUP BY 1)"""
    for digits in (6, 4, 2):
        level = f"""(SELECT bucket[1:{digits}] AS bucket, {hashed.format('bucket', 'hash')}, sum(n) AS n
      FROM {level} GROUP BY bucket[1:{digits}])"""
    return f"""(SELECT sum(n)::BIGINT AS n,
      sha256(string_agg(bucket || chr(0) || hash || chr(0), '' ORDER BY bucket)) AS fingerprint FROM {level}) {name}"""


_DOCUMENT_ENTRIES = "(SELECT doc_id::VARCHAR AS name, sha256(text) AS digest FROM documents)"
_PAGE_ENTRIES = "(SELECT page_id::VARCHAR AS name, sha256(html) AS digest FROM pages)"


@query("dataset_fingerprint", f"SELECT n, fingerprint FROM {_tree('t', _DOCUMENT_ENTRIES)}")
def documents_fingerprint(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return fingerprint.dataset_fingerprint(docs, "doc_id", "digest")


@query(
    "combined_fingerprint",
    f"""SELECT sha256('documents:' || d.fingerprint || chr(10) || 'pages:' || p.fingerprint) AS dataset_sha256
    FROM {_tree('d', _DOCUMENT_ENTRIES)}, {_tree('p', _PAGE_ENTRIES)}""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    return fingerprint.combined_fingerprint(
        [
            ("documents", documents_fingerprint(spark, folder)),
            ("pages", fingerprint.dataset_fingerprint(pages, "page_id", "digest")),
        ]
    )


@query(
    "document_key",
    """WITH files AS (
      SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'authentic/auth_' || printf('%04d', doc_id % 10000) || '.jpg'
          WHEN 1 THEN 'images/fg_auth_' || printf('%04d', doc_id % 10000) || '.png'
          WHEN 2 THEN 'images/fg_train_v2_' || printf('%04d', doc_id % 10000) || '.png'
          WHEN 3 THEN 'images/other.name.' || doc_id || '.png' WHEN 4 THEN 'x/auth_' || doc_id || '.jpg'
          ELSE 'images/fg_' || printf('%04d', doc_id % 10000) || '.png' END AS path,
        CASE doc_id % 4 WHEN 0 THEN 'midv2020' WHEN 1 THEN 'auth_' || doc_id || '.v1.jpg' WHEN 2 THEN '' END AS source,
        quality AS label FROM documents LEFT JOIN labels USING (doc_id)),
    stems AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM files)
    SELECT id, CASE WHEN source LIKE 'auth%' THEN regexp_replace(source, '\\.[^.]*$', '')
      WHEN label = 0 THEN stem WHEN stem LIKE 'fg\\_auth\\_%' ESCAPE '\\' THEN stem[4:]
      WHEN path LIKE 'authentic/%' THEN stem
      ELSE nullif(regexp_extract(stem, '^(?:auth|fg(?:_[A-Za-z0-9]+)*)_(\\d{4})$', 1), '') END AS document_key
    FROM stems""",
)
def _(spark, folder):
    key = F.col("doc_id")
    four = F.format_string("%04d", key % 10000)
    text = key.cast("string")
    path = (
        F.when(key % 6 == 0, F.concat(F.lit("authentic/auth_"), four, F.lit(".jpg")))
        .when(key % 6 == 1, F.concat(F.lit("images/fg_auth_"), four, F.lit(".png")))
        .when(key % 6 == 2, F.concat(F.lit("images/fg_train_v2_"), four, F.lit(".png")))
        .when(key % 6 == 3, F.concat(F.lit("images/other.name."), text, F.lit(".png")))
        .when(key % 6 == 4, F.concat(F.lit("x/auth_"), text, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("images/fg_"), four, F.lit(".png")))
    )
    source = (
        F.when(key % 4 == 0, "midv2020")
        .when(key % 4 == 1, F.concat(F.lit("auth_"), text, F.lit(".v1.jpg")))
        .when(key % 4 == 2, "")
    )
    files = table(spark, folder, "documents").select("doc_id").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    ).select(key.alias("id"), path.alias("path"), source.alias("source"), F.col("quality").alias("label"))
    return files.select(
        "id",
        document_key(F.col("path"), F.col("source"), F.col("label")).alias("document_key"),
    )
