"""Profile handles, names, identity scores and check digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import PROFILE_SOURCES
from tallymark.functions import handles as hd
from tallymark.functions.vectors import decode_data_url
from tallymark.operators import identity, validation
from tallymark.plans.catalog import query, table

WEIGHTS = {"github": 2.0, "leetcode": 1.0, "codeforces": 1.5}
STATUSES = ("ok", "ok", "not_found", "timeout", "unsupported", "error")


def persons(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_name").alias("person"))


def handle_rows(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Résumé handles, supplied handles and lookup statuses of customers, in long form."""
    customer = table(spark, folder, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    sources = F.array(*[F.lit(s) for s in PROFILE_SOURCES])
    base = customer.select(
        name.alias("person"), key.alias("key"), F.posexplode(sources).alias("pos", "source")
    )
    k, pos = F.col("key"), F.col("pos")
    # Every thirteenth customer has no handle at all.
    has = k % 13 != 0
    resume = base.where(has & ((k + pos) % 3 != 0)).select("person", "source", F.col("person").alias("handle"))
    supplied_kind = (k + pos * 2) % 4
    supplied = base.where(has & (supplied_kind != 3)).select(
        "person",
        "source",
        F.when(supplied_kind == 0, F.col("person"))
        .when(supplied_kind == 1, F.lower("person"))
        .otherwise("x")
        .alias("handle"),
    )
    kinds = F.array(*[F.lit(s) for s in STATUSES])
    statuses = base.where((k + pos) % 7 != 6).select(
        "person", "source", F.get(kinds, ((k + pos * 5) % 6).cast("int")).alias("status")
    )
    return resume, supplied, statuses


RESOLVED = """
base AS (
  SELECT c_name AS person, c_custkey AS k, pos, source FROM customer,
    (VALUES (0, 'github'), (1, 'leetcode'), (2, 'codeforces'), (3, 'stackoverflow')) s(pos, source)),
resume AS (SELECT person, source, person AS handle FROM base WHERE k % 13 <> 0 AND (k + pos) % 3 <> 0),
supplied AS (SELECT person, source, CASE (k + pos * 2) % 4 WHEN 0 THEN person WHEN 1 THEN lower(person)
             ELSE 'x' END AS handle FROM base WHERE k % 13 <> 0 AND (k + pos * 2) % 4 <> 3),
statuses AS (SELECT person, source, ['ok','ok','not_found','timeout','unsupported','error'][(k + pos * 5) % 6 + 1]
             AS status FROM base WHERE (k + pos) % 7 <> 6),
resolved AS (
  SELECT person, source, r.handle AS resume, s.handle AS submitted, st.status,
    CASE source WHEN 'github' THEN 2e0 WHEN 'leetcode' THEN 1e0 WHEN 'codeforces' THEN 1.5e0 ELSE 1e0 END AS weight,
    CASE WHEN lower(r.handle) <> lower(s.handle) THEN 'handle_mismatch' WHEN status = 'ok' THEN 'confirmed'
      WHEN status = 'not_found' THEN 'profile_not_found' WHEN status IN ('unsupported', 'not_provided') THEN 'excused'
      ELSE 'source_unavailable' END AS outcome
  FROM resume r FULL JOIN supplied s USING (person, source) LEFT JOIN statuses st USING (person, source)),
scored AS (
  SELECT person, round_even(100e0 * coalesce(sum(weight) FILTER (WHERE outcome = 'confirmed'), 0e0)
         / sum(weight), 0)::INTEGER AS score FROM resolved GROUP BY person)"""


def resolved(spark, folder) -> DataFrame:
    return identity.identity_resolve(*handle_rows(spark, folder), weights=WEIGHTS)


@query("identity_resolve", f"WITH {RESOLVED} SELECT * FROM resolved")
def _(spark, folder):
    return resolved(spark, folder)


@query(
    "identity_score",
    f"WITH {RESOLVED} SELECT c_name AS person, coalesce(score, 0) AS score "
    "FROM customer LEFT JOIN scored ON person = c_name",
)
def _(spark, folder):
    out = identity.identity_score(persons(spark, folder), resolved(spark, folder))
    return out.select("person", "score")


@query(
    "identity_discrepancies",
    f"""WITH {RESOLVED}, found AS (SELECT * FROM resolved WHERE outcome NOT IN ('confirmed', 'excused'))
    SELECT person, (row_number() OVER (PARTITION BY person ORDER BY source) - 1)::INTEGER AS position,
      source, outcome AS type, CASE WHEN outcome = 'handle_mismatch' THEN resume END AS resume,
      CASE WHEN outcome = 'handle_mismatch' THEN submitted END AS submitted,
      CASE WHEN outcome = 'profile_not_found' THEN coalesce(submitted, resume) END AS handle,
      CASE WHEN outcome = 'source_unavailable' THEN coalesce(status, 'missing') END AS status FROM found
    UNION ALL SELECT c_name, 0, NULL, 'no_profile_handle', NULL, NULL, NULL, NULL FROM customer
      WHERE c_name NOT IN (SELECT person FROM resolved)""",
)
def _(spark, folder):
    return identity.discrepancy_rows(
        identity.identity_score(persons(spark, folder), resolved(spark, folder))
    )


def resumes(spark, folder) -> DataFrame:
    """Résumé text and links of customers in several spellings."""
    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    nick = F.replace("c_name", F.lit("#"), F.lit("-"))
    text = F.concat(
        F.when(key % 5 == 0, F.lit("  \n e-mail: x@y.z\n")).otherwise(F.lit("")),
        F.lit("Jane   "), nick, F.lit("\nSee HTTPS://www.GitHub.com/"),
        F.when(key % 4 == 0, F.concat(nick, F.lit("%2Bx).")))
        .when(key % 4 == 1, F.concat(nick, F.lit("+y?tab=repos")))
        .otherwise(nick),
        F.when(key % 3 == 0, F.concat(F.lit("\nLeetCode: "), nick, F.lit("."))).otherwise(F.lit("")),
        F.when(key % 6 == 1, F.lit("\nstackoverflow.com/users/12345/the-user/more")).otherwise(F.lit("")),
        F.lit("\nend"),
    )
    urls = F.when(
        key % 2 == 0,
        F.array(
            F.concat(F.lit("https://codeforces.com/profile/z"), nick),
            F.concat(F.lit("http://codeforces.com/profile/a"), nick),
            F.concat(F.lit("http://codeforces.com/profile/a"), nick),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return customer.select(F.col("c_name").alias("person"), key.alias("key"), text.alias("text"), urls.alias("urls"))


RESUMES = """
resumes AS (
  SELECT c_name AS person, c_custkey AS k, replace(c_name, '#', '-') AS nick,
    CASE WHEN c_custkey % 5 = 0 THEN '  ' || chr(10) || ' e-mail: x@y.z' || chr(10) ELSE '' END
    || 'Jane   ' || replace(c_name, '#', '-') || chr(10) || 'See HTTPS://www.GitHub.com/'
    || replace(c_name, '#', '-') || CASE c_custkey % 4 WHEN 0 THEN '%2Bx).' WHEN 1 THEN '+y?tab=repos' ELSE '' END
    || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'LeetCode: ' || replace(c_name, '#', '-') || '.' ELSE '' END
    || CASE WHEN c_custkey % 6 = 1 THEN chr(10) || 'stackoverflow.com/users/12345/the-user/more' ELSE '' END
    || chr(10) || 'end' AS text,
    CASE WHEN c_custkey % 2 = 0 THEN 'http://codeforces.com/profile/a' || replace(c_name, '#', '-') || chr(10)
      || 'https://codeforces.com/profile/z' || replace(c_name, '#', '-') ELSE '' END AS urls
  FROM customer),
raw AS (
  SELECT person, 'github' AS source, regexp_extract(text || chr(10) || urls,
      '(?:https?://)?(?:www\\.)?github\\.com/([^/?#\\s]+)', 1, 'i') AS h FROM resumes
  UNION ALL SELECT person, 'leetcode', regexp_extract(text, '\\bleetcode\\b\\s*[:@]\\s*([A-Za-z0-9_.-]+)', 1, 'i')
    FROM resumes
  UNION ALL SELECT person, 'codeforces', regexp_extract(text || chr(10) || urls,
      '(?:https?://)?(?:www\\.)?codeforces\\.com/profile/([^/?#\\s]+)', 1, 'i') FROM resumes
  UNION ALL SELECT person, 'stackoverflow', regexp_extract(text || chr(10) || urls,
      '(?:https?://)?(?:www\\.)?stackoverflow\\.com/users/(?:\\d+/)?([^/?#\\s]+)', 1, 'i') FROM resumes),
extracted AS (
  SELECT person, source, trim(url_decode(replace(h, '+', '%2B')), '.,;:)]}>') AS handle FROM raw WHERE h <> '')"""


@query("extract_handles", f"WITH {RESUMES} SELECT * FROM extracted WHERE handle <> ''")
def _(spark, folder):
    rows = resumes(spark, folder)
    found = rows.select("person", hd.extract_handles(F.col("text"), F.col("urls")).alias("handles"))
    return identity.handles_long(found, "handles")


@query(
    "extract_name",
    f"""WITH {RESUMES} SELECT person, 'Jane ' || nick AS name FROM resumes""",
)
def _(spark, folder):
    return resumes(spark, folder).select("person", hd.extract_name(F.col("text")).alias("name"))


@query(
    "document_names",
    r"""WITH lines AS (
      SELECT doc_id, i, trim(regexp_replace(line, '[\s\x{0B}\x{85}\x{A0}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line
      FROM (SELECT doc_id, unnest(range(1, 9)) AS i,
                   regexp_split_to_array(text, '\r\n|[\n\x{0B}\f\r\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]') AS parts
            FROM documents), LATERAL (SELECT parts[i] AS line) WHERE i <= len(parts))
    SELECT doc_id AS id, arg_min(line, i) FILTER (WHERE length(line) BETWEEN 2 AND 80 AND NOT
      regexp_matches(line, '[@:/]|github|leetcode|codeforces|stackoverflow', 'i')) AS name
    FROM lines GROUP BY doc_id""",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), hd.extract_name(F.col("text")).alias("name")
    )


@query(
    "profile_url",
    f"""WITH {RESUMES} SELECT person, source, CASE source WHEN 'github' THEN 'https://github.com/'
      WHEN 'leetcode' THEN 'https://leetcode.com/u/' WHEN 'codeforces' THEN 'https://codeforces.com/profile/'
      ELSE 'https://stackoverflow.com/users/' END || handle AS url FROM extracted WHERE handle <> ''""",
)
def _(spark, folder):
    rows = resumes(spark, folder)
    found = rows.select("person", hd.extract_handles(F.col("text"), F.col("urls")).alias("handles"))
    long = identity.handles_long(found, "handles")
    return long.select("person", "source", hd.profile_url(F.col("source"), F.col("handle")).alias("url"))


@query(
    "discover_profiles",
    f"""WITH {RESUMES}, blobs AS (SELECT person, text || ' ' || urls AS blob, k FROM resumes)
    SELECT person, 'github' AS source, 'https://github.com/' || k AS url FROM blobs
    UNION ALL SELECT person, 'codeforces', 'https://codeforces.com/profile/'
      || regexp_extract(blob, 'codeforces\\.com/profile/([A-Za-z0-9_-]+)', 1) FROM blobs
      WHERE blob LIKE '%codeforces.com/profile/%'
    UNION ALL SELECT person, 'stackoverflow', 'https://stackoverflow.com/users/the-user' FROM blobs
      WHERE blob LIKE '%stackoverflow.com/users/%'""",
)
def _(spark, folder):
    rows = resumes(spark, folder)
    blob = F.concat_ws(" ", F.col("text"), F.array_join(hd.url_distinct_sorted(F.col("urls")), " "))
    github = F.concat(F.lit("https://github.com/"), F.col("key").cast("string"))
    found = rows.select("person", hd.discover_profiles(github, blob).alias("profiles"))
    return identity.handles_long(found, "profiles", name="url")


@query(
    "merge_handles",
    """SELECT c_name AS person, source, handle FROM customer, LATERAL (
      SELECT 'github' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'given' ELSE c_name END AS handle
      UNION ALL SELECT 'leetcode', 'lc' || c_custkey
      UNION ALL SELECT 'codeforces', 'cf' || c_custkey WHERE c_custkey % 2 = 0)""",
)
def _(spark, folder):
    key = F.col("c_custkey")
    text = key.cast("string")
    resume = F.create_map(
        F.lit("github"), F.col("c_name"), F.lit("leetcode"), F.concat(F.lit("lc"), text)
    )
    form = F.create_map(
        F.lit("profile_github"), F.when(key % 3 == 0, " given ").otherwise("  "),
        F.lit("profile_codeforces"), F.when(key % 2 == 0, F.concat(F.lit("cf"), text)),
        F.lit("profile_unknown"), F.lit("u"),
        F.lit("note"), F.lit("n"),
    )
    merged = hd.merge_handles(F.col("resume"), hd.supplied_profiles(F.col("form")))
    base = table(spark, folder, "customer").select(
        F.col("c_name").alias("person"), resume.alias("resume"), form.alias("form")
    )
    return identity.handles_long(base.select("person", merged.alias("handles")), "handles")


@query(
    "page_urls",
    """SELECT page_id AS id, array_to_string(list_sort(list_distinct([url, url,
      'http://' || split_part(url, '/', 3)])), ' ') AS urls FROM pages""",
)
def _(spark, folder):
    host = F.concat(F.lit("http://"), F.split_part("url", F.lit("/"), F.lit(3)))
    urls = hd.url_distinct_sorted(F.array(F.col("url"), F.col("url"), host))
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.array_join(urls, " ").alias("urls")
    )


@query(
    "discrepancy_prevalence",
    """WITH flat AS (SELECT 'skills' AS field, 'add' AS action FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 'education', 'inflate' FROM customer WHERE c_custkey % 4 = 0)
    SELECT field, action, count(*) AS n_rows,
      (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS n_records_with,
      (SELECT count(*) FROM customer) AS n_records,
      (SELECT count(*) FILTER (WHERE c_custkey % 2 = 0)::DOUBLE / count(*) FROM customer) AS share
    FROM flat GROUP BY ALL""",
)
def _(spark, folder):
    key = F.col("c_custkey")

    def planted(field: str, action: str):
        return F.create_map(F.lit("field"), F.lit(field), F.lit("action"), F.lit(action))

    rows = (
        F.when(key % 4 == 0, F.array(planted("skills", "add"), planted("education", "inflate")))
        .when(key % 2 == 0, F.array(planted("skills", "add")))
        .when(key % 3 == 0, F.array().cast("array<map<string,string>>"))
    )
    return identity.discrepancy_prevalence(
        table(spark, folder, "customer").select(rows.alias("gt_discrepancies"))
    )


# The tables once more, so that the SQL does not depend on the operator's copy (fixed values).
_PRODUCT = """[
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
]"""
_POSITION = """[
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]
]"""
_STATE = "0"
for _i in range(12):
    _STATE = (
        f"d[{_STATE} + 1][p[{_i % 8 + 1}][substr(number, {12 - _i}, 1)::INTEGER + 1] + 1]"
    )


@query(
    "idnumber_checksum_scan",
    f"""WITH numbers AS (
      SELECT o_orderstatus AS status, lpad((o_orderkey * 104729 + 7919)::VARCHAR, 12, '2') AS number,
        {_PRODUCT} AS d, {_POSITION} AS p FROM orders),
    checked AS (SELECT status, {_STATE} = 0 AS ok FROM numbers)
    SELECT status, 2 * count(*) AS candidates, count(*) FILTER (WHERE ok) AS valid,
      count(*) + count(*) FILTER (WHERE NOT ok) AS invalid FROM checked GROUP BY status""",
)
def _(spark, folder):
    number = F.lpad((F.col("o_orderkey") * 104729 + 7919).cast("string"), 12, "2")
    # A second number of twelve ones, and a longer one that is no candidate.
    text = F.concat(F.lit("id "), number, F.lit("; 111111111111, 1234567890123"))
    texts = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"), text.alias("text"))
    return validation.idnumber_checksum_scan(texts, ["status"])


@query(
    "decode_data_url",
    """SELECT page_id AS id, octet_length(encode(html))::INTEGER AS n_bytes, md5(html) AS digest
    FROM pages""",
)
def _(spark, folder):
    encoded = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "")
    sent = F.when(
        F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;base64,"), encoded)
    ).otherwise(encoded)
    content = decode_data_url(sent)
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.octet_length(content).alias("n_bytes"),
        F.md5(content).alias("digest"),
    )
