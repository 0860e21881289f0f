"""Mixing sources to target weights by Pareto order sampling.

Sources share a multiple of all words by weight; a target stops at ``most`` times its source and
the excess goes to the others by weight. Within a source, a document expects ``copies`` of itself,
fewer the longer it is, and never more than ``most``. The whole part is allocated; the fraction is
an inclusion chance *p*. Documents are ranked by random odds over inclusion odds,
``u / (1 - u) / (p / (1 - p))`` with *u* from a digest of seed, id and text, and taken in that order
until the words still missing from the target are reached: a sample of fixed size in words whose
documents have unequal chances.

No source is sorted whole: ranks are mapped into (0, 1) and cut into bins, the words of each bin
are summed map-side, and only the one bin in which a source reaches its target is put in order.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of
its own, last in order. Rows alike in id, source and text rank alike and are in or out together. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import store, unused
from tallymark.operators.joins import hot_split_join

BINS = 16384
SEED = 7


def water_level(rows: DataFrame, within: list[str], order: list, total, cap, weight, fits) -> DataFrame:
    """Share ``total`` by ``weight`` with caps, per group ``within``: adds ``full`` and ``level``.

    ``order`` puts the rows whose cap is reached at the lowest level first; ``fits(level)`` says
    whether a row at that level stays within its cap. Groups are small summaries.
    """
    along = W.partitionBy(*within).orderBy(*order)
    before = F.sum(cap).over(along.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum(weight).over(along.rowsBetween(0, W.unboundedFollowing))
    level = F.try_divide(
        total - F.coalesce(before.cast("double"), F.lit(0.0)), rest.cast("double")
    )
    rows = rows.withColumn("rank", F.row_number().over(along)).withColumn("level", level)
    first = F.min(F.when(fits(F.col("level")), F.struct("rank", "level")))
    rows = rows.withColumn("first", first.over(W.partitionBy(*within)))
    full = F.coalesce(F.col("rank") < F.col("first.rank"), F.lit(False))
    rows = rows.withColumn("full", full)
    return rows.withColumn("level", F.coalesce("first.level", F.lit(0.0))).drop("rank", "first")


def source_targets(rows: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(mark, source_size, target), a row per source; ``rows`` has mark, source and size."""
    totals = rows.groupBy("mark", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    whole = F.sum("source_size").over(W.partitionBy()) * F.lit(percent / 100)
    totals = totals.withColumn("weight", weight.cast("long")).withColumn("whole", whole)
    cap = F.col("source_size") * most
    shared = water_level(
        totals,
        [],
        [F.col("source_size") / F.col("weight"), "mark"],
        F.col("whole"),
        cap,
        F.col("weight"),
        lambda level: level * F.col("weight") <= cap,
    )
    target = F.when(F.col("full"), cap.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return shared.select("mark", "source_size", target.alias("target"))


def expected_copies(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(mark, digits, n, whole, p, missing, source_size, target) by source and binary digits of size.

    ``whole`` copies are certain, one more has the chance ``p``, and ``missing`` words of the source
    are left to these chances.
    """
    classes = rows.groupBy("mark", "digits").agg(
        F.sum("size").alias("words"), F.count("*").alias("n")
    )
    chance = F.expr("1000000 div (digits + 8)")
    classes = classes.join(targets, "mark").withColumn("chance", chance)
    classes = water_level(
        classes,
        ["mark"],
        ["digits"],
        F.col("target"),
        F.col("words") * most,
        F.col("words").cast("decimal(20,0)") * F.col("chance").cast("decimal(10,0)"),
        lambda level: level * F.col("chance") <= most,
    )
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(F.col("level") * F.col("chance"))
    classes = classes.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    certain = F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("mark"))
    return classes.select(
        "mark",
        "digits",
        "n",
        "whole",
        (F.col("copies") - F.col("whole")).alias("p"),
        (F.col("target") - certain).alias("missing"),
        "source_size",
        "target",
    )


def random_share(id_col: str, text_col: str, seed: int):
    """A number in (0, 1) from seed, id and text, the same in every run and engine."""
    own = F.concat_ws(
        ":",
        F.lit(str(seed)),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.md5(F.coalesce(text_col, F.lit(""))),
    )
    return (F.conv(F.substring(F.md5(own), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """(id, u, size, source_size, target, copies, taken), a row per document; ``u`` is its random number.

    ``weights`` repeat over the sources in order; ``percent`` of all words are shared; ``most``
    bounds the copies of a document and the target of a source.
    """
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("mark"),
        size.alias("size"),
        random_share(id_col, text_col, seed).alias("u"),
    )
    digits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    rows = store(rows.withColumn("digits", digits), "mix-rows")
    targets = source_targets(rows, weights, percent, most)
    classes = store(expected_copies(rows, targets, most), "mix-classes")

    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    placed = hot_split_join(rows, classes, ["mark", "digits"], "n").drop("n", "source", "digits")
    placed = placed.withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
    placed = placed.withColumn("x", F.col("odds") / (1 + F.col("odds"))).drop("odds", "p")
    placed = store(placed.withColumn("bin", F.floor(F.col("x") * BINS)), "mix-placed")

    bins = placed.where("bin IS NOT NULL").groupBy("mark", "bin", "missing")
    bins = bins.agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("mark").orderBy("bin"))
    bins = bins.withColumn("before", upto - F.col("words"))
    cut = bins.where("before < missing AND before + words >= missing")
    cuts = (
        classes.groupBy("mark", "missing")
        .agg(F.sum("n").alias("n"))
        .join(cut.select("mark", "bin", "before").withColumnRenamed("bin", "cut"), "mark", "left")
        .withColumn("cut", F.coalesce("cut", F.when(F.col("missing") > 0, BINS + 1).otherwise(-1)))
    )
    cuts = store(cuts.drop("missing"), "mix-cuts")
    ranked = hot_split_join(placed, cuts, ["mark"], "n")

    away = ranked.where("bin IS NULL OR bin <> cut")
    away = away.withColumn("extra", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)))
    near = ranked.where("bin = cut")
    alike = F.sum("size").over(W.partitionBy("mark", "x"))
    upto = F.sum("size").over(W.partitionBy("mark").orderBy("x"))
    near = near.withColumn("alike", alike).withColumn("upto", upto)
    near = near.withColumn(
        "extra", F.col("before") + F.col("upto") - F.col("alike") / 2 <= F.col("missing")
    ).drop("alike", "upto")
    copies = F.col("whole") + F.col("extra").cast("long")
    return away.unionByName(near).select(
        F.col("id").alias(id_col),
        "u",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how
) -> DataFrame:
    """The mix itself: all columns, a row per copy taken, numbered from 1 in ``copy``.

    A document of size 0 has no words to take and stays once.
    """
    u, key, copy = unused(docs, "u"), unused(docs, "key"), unused(docs, "copy")
    many = unused(docs, "copies")
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    mix = mix_sources(narrow, "id", "source", "text", **how)
    taken = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    mix = mix.groupBy(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias(key), F.col("u").alias(u)
    ).agg(F.max(taken).alias(many))
    seed = how.get("seed", SEED)
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = rows.withColumn(u, random_share(id_col, text_col, seed)).join(mix, [key, u])
    rows = rows.where(F.col(many) > 0)
    return rows.select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))).alias(copy)
    )


ORACLE = r"""
WITH rows AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           (('0x' || md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:12])::BIGINT
             ::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM rows GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][((place - 1) % 3) + 1] AS weight,
           (sum(source_size) OVER ())::DOUBLE * 1.5 AS whole,
           row_number() OVER (ORDER BY source_size / [5, 2, 1][((place - 1) % 3) + 1], place) AS rank
    FROM totals
), levels AS (
    SELECT *, (whole - coalesce((sum(2 * source_size) OVER (ORDER BY rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0))
              / (sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
              AS level
    FROM weighed
), opened AS (
    SELECT min(rank) AS rank FROM levels WHERE level * weight <= 2 * source_size
), targets AS (
    SELECT source, source_size,
           CASE WHEN rank < (SELECT rank FROM opened) THEN (2 * source_size)::DOUBLE
                ELSE (SELECT level FROM levels WHERE rank = (SELECT rank FROM opened)) * weight END AS target
    FROM levels
), sized AS (
    SELECT r.*, t.source_size, t.target, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS digits
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), classes AS (
    SELECT source, digits, sum(size)::BIGINT AS words, any_value(target) AS target,
           1000000 // (digits + 8) AS chance
    FROM sized GROUP BY source, digits
), filled AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY digits) AS rank,
           (target - coalesce((sum(2 * words) OVER (PARTITION BY source ORDER BY digits
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0))
           / nullif((sum(words::HUGEINT * chance) OVER (PARTITION BY source ORDER BY digits
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0.0) AS level
    FROM classes
), firsts AS (
    SELECT source, min(rank) AS first, arg_min(level, rank) AS level
    FROM filled WHERE level * chance <= 2 GROUP BY source
), copies AS (
    SELECT f.source, f.digits, f.words, f.target,
           CASE WHEN f.rank < o.first THEN 2.0::DOUBLE ELSE coalesce(o.level, 0.0) * f.chance END AS copies
    FROM filled f LEFT JOIN firsts o ON f.source IS NOT DISTINCT FROM o.source
), parts AS (
    SELECT source, digits, floor(copies) AS whole, copies - floor(copies) AS p,
           target - (sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS missing
    FROM copies
), ranked AS (
    SELECT s.*, p.whole, p.missing,
           CASE WHEN p.p > 0 AND s.size > 0 THEN s.u * (1 - p.p) / ((1 - s.u) * p.p) END AS odds
    FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source AND s.digits = p.digits
), placed AS (
    SELECT *, odds / (1 + odds) AS x FROM ranked
), summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY x RANGE UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER (PARTITION BY source, x) AS alike
    FROM placed WHERE x IS NOT NULL
    UNION ALL SELECT *, NULL, NULL FROM placed WHERE x IS NULL
)
SELECT doc_id, size, source_size, target,
       ((whole + coalesce((upto - alike / 2 <= missing)::INT, 0)) * size)::BIGINT AS taken
FROM summed
"""
