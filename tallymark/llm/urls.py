"""URL filters: rules by host and path, and link-graph propagation for the rest.

Hosts are the nodes. A page's absolute links are edges between hosts, weighted by the number of
pages; a host and its parent domain are tied both ways, as whoever runs one runs the other. Trust is
a personalised PageRank from the hosts of pages that a rule allows, along the links; distrust starts
at the hosts of pages that a rule blocks and runs against the links, since who links to a bad host
is suspect. A host is blocked where its distrust exceeds its trust by more than ``margin``. A rule's
own verdict always stands.

Pages are read once for urls and links; what is shuffled is one row per pair of hosts after map-side
aggregation. A host with a third of all pages is one node; its pages get the verdict over the
broadcast path of the hot split join. Every round is written below the shared folder.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule, is no
node, and is allowed. A null or empty html has no links. Repeated rows count again and are judged
alike. Host names longer than 253 characters, which no name server knows, get no parent. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import lowered, store
from tallymark.operators.joins import hot_split_join

#: Verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

LINK = r"""(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
ROUNDS = 10
DAMPING = 0.85
MARGIN = 1e-9


def url_parts(url):
    """(host, path) columns: host after the first ``://`` with A-Z lowered, path up to ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lowered(host), path


def rule_of(rules):
    """The longest rule that fits columns ``host`` and ``path``, as struct (rule, verdict), or null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in reversed(longest):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col(
            "path"
        ).startswith(path)
        named = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts; ``pages`` has host and links."""
    linked = pages.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    linked = linked.where("src <> '' AND dst <> '' AND src <> dst")
    linked = linked.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = pages.select("host").unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    steps = F.when(
        (F.length("host") <= 253) & (F.size(labels) > 2),
        F.transform(
            F.sequence(F.lit(1), F.size(labels) - 2),
            lambda i: F.struct(
                F.array_join(F.slice(labels, i, 254), ".").alias("low"),
                F.array_join(F.slice(labels, i + 1, 254), ".").alias("high"),
            ),
        ),
    )
    ties = hosts.select(F.explode(steps).alias("tie")).select("tie.low", "tie.high")
    ties = ties.where("low <> '' AND high <> ''").distinct()
    up = ties.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(1).alias("weight"))
    down = ties.select(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(1).alias("weight"))
    every = linked.unionByName(up).unionByName(down)
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, trust, distrust) of every host that either has reached.

    ``seeds``: (kind, host, seed), of kind ``allow`` along the edges and ``block`` against them.
    """
    along = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight")
    against = edges.select(
        F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"
    )
    moves = along.unionByName(against)
    sums = moves.groupBy("kind", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    sums = store(sums, "host-out")
    share = F.col("weight").cast("double") / F.col("out")
    moves = hot_split_join(moves, sums, ["kind", "src"], "n")
    moves = store(moves.select("kind", "src", "dst", share.alias("share")), "host-moves")
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    for _ in range(rounds):
        passed = moves.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = store(
            passed.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score")),
            "host-scores",
        )
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules=RULES,
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    margin: float = MARGIN,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust), a row per page."""
    host, path = url_parts(F.col(url_col))
    links = F.transform(
        F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), 1), lowered
    )
    parsed = pages.select(
        F.col(id_col).alias("id"),
        host.alias("host"),
        path.alias("path"),
        F.array_distinct(links).alias("links"),
    )
    parsed = store(parsed.withColumn("rule", rule_of(rules)), "page-urls")
    counted = parsed.groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rule.verdict") == "allow").alias("allow"),
        F.count_if(F.col("rule.verdict") == "block").alias("block"),
    )
    counted = store(counted, "page-hosts")
    kinds = F.explode(F.array(*(_seed(kind) for kind in ("allow", "block")))).alias("seed")
    seeds = counted.where("host <> ''").select("host", kinds).select("host", "seed.*").where("pages > 0")
    totals = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    seeds = seeds.join(F.broadcast(totals), "kind")  # two rows
    seeds = seeds.select("kind", "host", (F.col("pages").cast("double") / F.col("all")).alias("seed"))
    scores = host_scores(host_edges(parsed), store(seeds, "host-seeds"), rounds, damping)
    judged = counted.select("host", "n").join(scores, "host", "left")
    judged = store(judged.na.fill(0.0, ["trust", "distrust"]), "host-verdicts")
    own = F.when(F.col("distrust") > F.col("trust") + margin, "block").otherwise("allow")
    return hot_split_join(parsed.drop("links"), judged, ["host"], "n").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", own).alias("verdict"),
        "trust",
        "distrust",
    )


def _seed(kind: str):
    return F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("pages"))


def _oracle() -> str:
    """The same in one statement: a materialised table per round."""
    rounds = []
    for i in range(1, ROUNDS + 1):
        last = "seeds" if i == 1 else f"scores{i - 1}"
        rounds.append(f"""scores{i} AS MATERIALIZED (
    SELECT kind, host, sum(score) AS score FROM (
        SELECT m.kind, m.dst AS host, s.score * m.share * 0.85::DOUBLE AS score
        FROM moves m JOIN {last} s ON m.kind = s.kind AND m.src = s.host
        UNION ALL SELECT kind, host, score * (1 - 0.85::DOUBLE) FROM seeds
    ) GROUP BY kind, host
)""")
    return r"""
WITH rests AS (
    SELECT page_id, html,
           CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), hosts AS (
    SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS named FROM rests
), parts AS (
    SELECT page_id, html,
           translate(named, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substring(rest, length(named) + 1), '^[^?#]*') AS path
    FROM hosts
), judged AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
            THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
            THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
        END AS rule
    FROM parts
), ruled AS (
    SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                   WHEN rule IS NOT NULL THEN 'block' END AS given
    FROM judged
), links AS (
    SELECT host AS src, unnest(list_distinct(
        [translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN
         regexp_extract_all(coalesce(html, ''),
            '(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)])) AS dst
    FROM ruled
), linked AS (
    SELECT src, dst, count(*) AS weight FROM links
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), named AS (
    SELECT host, string_split(host, '.') AS labels
    FROM (SELECT host FROM ruled UNION SELECT dst FROM linked)
    WHERE length(host) <= 253 AND len(string_split(host, '.')) > 2
), ties AS (
    SELECT DISTINCT array_to_string(labels[i:], '.') AS low, array_to_string(labels[i + 1:], '.') AS high
    FROM (SELECT labels, unnest(range(1, len(labels) - 1)) AS i FROM named)
), edges AS (
    SELECT src, dst, sum(weight) AS weight FROM (
        SELECT src, dst, weight FROM linked
        UNION ALL SELECT low, high, 1 FROM ties WHERE low <> '' AND high <> ''
        UNION ALL SELECT high, low, 1 FROM ties WHERE low <> '' AND high <> ''
    ) GROUP BY src, dst
), both_ways AS (
    SELECT 'allow' AS kind, src, dst, weight FROM edges
    UNION ALL SELECT 'block', dst, src, weight FROM edges
), moves AS MATERIALIZED (
    SELECT kind, src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways
), seeds AS MATERIALIZED (
    SELECT given AS kind, host, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY given) AS score
    FROM ruled WHERE given IS NOT NULL AND host <> '' GROUP BY given, host
), """ + ",\n".join(rounds) + f""",
verdicts AS (
    SELECT host, sum(CASE WHEN kind = 'block' THEN score ELSE 0 END)
                 > sum(CASE WHEN kind = 'allow' THEN score ELSE 0 END) + {MARGIN} AS bad
    FROM scores{ROUNDS} GROUP BY host
)
SELECT page_id, r.host, path, rule,
       coalesce(given, CASE WHEN coalesce(bad, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN verdicts v ON r.host = v.host
"""


ORACLE = _oracle()
