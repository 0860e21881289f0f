"""Merkle manifest of a dataset: digests, proofs and their check by nested-interval labels.

Every node is labelled by the interval ``[lo, hi)`` of the leaf ranks it covers. Ranks within a
group come from a range shuffle, so a group of any size is cut over many tasks. Level by level,
sixteen consecutive intervals become one node that keeps the labels and digests of its children;
a group with one node left passes it on unchanged. On the way down, nodes join their ancestor on
the bucket of its level (``lo`` divided by the width of a node of that level) and containment of
the interval; what the ancestor's interval holds beyond the node's own, before it and after it,
are the node's siblings. Each join meets at most sixteen rows with one, whatever the group.
The groups' roots are the leaves of a second tree, built and attached the same way.

Building runs jobs: the leaves, their ranks and each level are written below the shared folder.

Defined cases: a null field counts as ``-``, a null text too; texts of any length are hashed whole
in the JVM; equal ids are ordered by leaf digest (a tie beyond that is a repeated row, whose copies
are alike); null ids come first and are never tampered with; a null group is a group of its own
and comes first; an empty table has no rows and no root; columns that are not named are not read,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ordering import positions
from tallymark.session import materialize

#: Children of a node.
FAN = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of the values: each ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    shown = []
    for value in values:
        text = value.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*shown), 256)


def chosen_for_tampering(id_value: Column, one_in: int = 5) -> Column:
    """Whether the CRC32 of the id, written in decimal, is divisible by ``one_in``; never for null."""
    return F.coalesce(F.crc32(id_value.cast("string").cast("binary")) % one_in == 0, F.lit(False))


def _with_parents(nodes: DataFrame, level: int) -> DataFrame:
    """One row per node of the level: label, digest, and labels and digests of its children."""
    width = FAN**level
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
    grouped = nodes.groupBy("mark", F.expr(f"lo div {width}").alias("bucket")).agg(kids.alias("kids"))
    alone = (F.size("kids") == 1) & (F.col("bucket") == 0)
    return grouped.select(
        "mark",
        F.col("kids")[0]["lo"].alias("lo"),
        F.element_at("kids", -1)["hi"].alias("hi"),
        F.when(alone, F.col("kids")[0]["digest"])
        .otherwise(F.sha2(F.array_join("kids.digest", ""), 256))
        .alias("digest"),
        "kids",
        alone.alias("passed_on"),
    )


def build_levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels above the leaves (mark, lo, hi, digest) up to one node per group."""
    last = leaves.agg(F.max("lo")).first()[0] or 0
    levels: list[DataFrame] = []
    while FAN ** len(levels) <= last:
        below = levels[-1] if levels else leaves
        levels.append(materialize(_with_parents(below, len(levels) + 1)))
    return levels


def attach_ancestors(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``steps``, the siblings on each level up to the group's root and beyond.

    ``tops`` holds a row per group: mark, the ``steps`` above its root, and columns to hand down.
    """
    handed = [c for c in tops.columns if c not in ("mark", "steps")]
    # A group's last level has one node, so that this join has one row on either side of a key.
    top_level = levels[-1] if levels else leaves
    paths = top_level.join(tops, "mark")
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 2] if level > 1 else leaves
        width = FAN**level
        parents = paths.select(
            F.col("mark").alias("p_mark"),
            F.expr(f"lo div {width}").alias("p_bucket"),
            F.col("lo").alias("p_lo"),
            F.col("hi").alias("p_hi"),
            F.col("kids").alias("p_kids"),
            F.col("passed_on").alias("p_passed_on"),
            "steps",
            *handed,
        )
        meets = (
            (F.col("n.mark") == F.col("p.p_mark"))
            & (F.expr(f"n.lo div {width}") == F.col("p.p_bucket"))
            & (F.col("p.p_lo") <= F.col("n.lo"))
            & (F.col("n.hi") <= F.col("p.p_hi"))
        )
        own = F.when(F.col("p_passed_on"), F.array()).otherwise(F.array(_step("p_kids")))
        paths = nodes.alias("n").join(parents.alias("p"), meets).select(
            "n.*", F.concat(own, F.col("steps")).alias("steps"), *handed
        )
    return paths


def _step(kids: str) -> Column:
    """What the parent's interval holds before and after the node's own, as joined digests."""
    before = F.filter(kids, lambda k: k["hi"] <= F.col("n.lo"))
    after = F.filter(kids, lambda k: k["lo"] >= F.col("n.hi"))
    return F.struct(
        F.array_join(F.transform(before, lambda k: k["digest"]), "").alias("left"),
        F.array_join(F.transform(after, lambda k: k["digest"]), "").alias("right"),
    )


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, steps, other): every row's leaf, roots and siblings.

    ``other`` is the leaf of the row with the columns of ``tampered`` put in place, where ``when``
    holds; else the leaf itself.
    """
    changed = tampered or {}
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([changed.get(f, F.col(f)) for f in fields])
    source = F.col(group).cast("string")
    # A mark is never null, and marks sort like groups with null first.
    leaves = docs.select(
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("mark"),
        F.col(id_col).alias("id"),
        leaf.alias("digest"),
        (F.when(when, other) if when is not None else F.lit(None).cast("string")).alias("other"),
    )
    ranked = positions(materialize(leaves), ["id", "digest"], ["mark"]).withColumnRenamed("position", "hi")
    ranked = materialize(ranked.withColumn("lo", F.col("hi") - 1))
    labels = ranked.select("mark", "lo", "hi", "digest")
    levels = build_levels(labels)

    subroots = (levels[-1] if levels else labels).select("mark", "digest")
    numbered = positions(subroots, ["mark"]).select(
        F.lit("").alias("mark"),
        (F.col("position") - 1).alias("lo"),
        F.col("position").alias("hi"),
        "digest",
        F.col("mark").alias("group_mark"),
    )
    numbered = materialize(numbered)
    above = build_levels(numbered)
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    roots = (above[-1] if above else numbered).select("mark", no_steps.alias("steps"), F.col("digest").alias("root"))
    placed = attach_ancestors(numbered, above, roots)
    tops = placed.select(
        F.col("group_mark").alias("mark"), "steps", F.col("digest").alias("subroot"), "root"
    )
    found = attach_ancestors(ranked, levels, materialize(tops))
    return found.select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "steps",
        F.coalesce("other", "digest").alias("other"),
    )


def checked(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest with the digest of each proof, the root recomputed from ``other``, and the verdict."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return manifest.select(
        id_col,
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.col("other"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in SQL, with recursive levels, a table-driven CRC32 and a fold over lists.
ORACLE = """
WITH RECURSIVE
crc_step(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
crc AS (
  SELECT id, xor(list_reduce(
      [ascii(x)::BIGINT FOR x IN string_split(id::VARCHAR, '')],
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS code
  FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL), crc_table),
shown AS (
  SELECT d.doc_id, d.source, d.text, coalesce(crc.code % 5 = 0, false) AS chosen,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-')
    || coalesce(strlen(d.source) || ':' || d.source, '-')
    || coalesce(strlen(d.lang) || ':' || d.lang, '-')
    || coalesce(strlen(d.n_chars::VARCHAR) || ':' || d.n_chars, '-') AS head
  FROM documents d LEFT JOIN crc ON crc.id = d.doc_id),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN chosen
      THEN coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END) AS other
  FROM shown),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
below(source, level, idx, h, n) AS (
  SELECT source, 0, place, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16)
  FROM below WHERE n > 1 GROUP BY source, level, idx // 16),
subroots AS (
  SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM below WHERE n = 1),
above(level, idx, h, n) AS (
  SELECT 0, place, h, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16)
  FROM above WHERE n > 1 GROUP BY level, idx // 16),
low_steps AS (
  SELECT m.source, m.level, m.idx,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx < m.idx), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx > m.idx), '') AS r
  FROM below m JOIN below s ON m.source IS NOT DISTINCT FROM s.source AND m.level = s.level
    AND m.idx // 16 = s.idx // 16
  WHERE m.n > 1 GROUP BY m.source, m.level, m.idx),
high_steps AS (
  SELECT m.level, m.idx,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx < m.idx), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx > m.idx), '') AS r
  FROM above m JOIN above s ON m.level = s.level AND m.idx // 16 = s.idx // 16
  WHERE m.n > 1 GROUP BY m.level, m.idx),
low_path AS (
  SELECT v.source, v.place, list(s.l || '|' || s.r ORDER BY s.level) AS steps
  FROM leaves v JOIN low_steps s ON v.source IS NOT DISTINCT FROM s.source
    AND s.idx = v.place // (16 ** s.level)::BIGINT
  GROUP BY v.source, v.place),
high_path AS (
  SELECT v.source, list(s.l || '|' || s.r ORDER BY s.level) AS steps
  FROM subroots v JOIN high_steps s ON s.idx = v.place // (16 ** s.level)::BIGINT
  GROUP BY v.source),
whole AS (
  SELECT v.doc_id, v.leaf, v.other, b.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root,
    coalesce(lo.steps, []) || coalesce(hi.steps, []) AS steps
  FROM leaves v JOIN subroots b ON v.source IS NOT DISTINCT FROM b.source
  LEFT JOIN low_path lo ON v.source IS NOT DISTINCT FROM lo.source AND v.place = lo.place
  LEFT JOIN high_path hi ON v.source IS NOT DISTINCT FROM hi.source),
folded AS (
  SELECT *, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
    list_reduce([other] || steps, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
