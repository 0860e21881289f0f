"""Same and different pairs for face comparison, and their sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.fixedvalues import (
    CAPTURE_ORDER,
    DIFF_BAND,
    DOCUMENT_NAMES,
    FIELD_ORIGIN,
    SAME_BAND,
    SELFIE_NAMES,
    TOTAL_BAND,
)
from tallymark.functions.documents import stem
from tallymark.operators.joins import null_safe_join
from tallymark.operators.ordering import positions, seeded_rank
from tallymark.operators.sweep import (
    PAIR_TARGETS,
    maximin_threshold,
    score_histogram_counts,
    sweep_from_counts,
)


def _path_order(path: str = "path") -> Column:
    """Paths compare part by part."""
    return F.split(F.col(path), "/")


def paired_captures(scans: DataFrame, photos: DataFrame) -> DataFrame:
    """Scan and photo of one document (code, idx), both with a face box."""
    boxed = F.col("face_box").isNotNull()
    return scans.where(boxed).select("code", "idx", F.col("path").alias("scan_path")).join(
        photos.where(boxed).select("code", "idx", F.col("path").alias("photo_path")),
        ["code", "idx"],
    )


def same_pairs(images: DataFrame, identity: str = "identity") -> DataFrame:
    """Every pair of captures of an identity, in the order photo, scan, video_frame.

    A capture is represented by its first image by path, so an identity has at most three.
    """
    firsts = images.groupBy(identity).agg(
        *[F.min(F.when(F.col("capture") == c, F.col("path"))).alias(c) for c in CAPTURE_ORDER]
    )
    pairs = [
        F.struct(
            F.lit(a).alias("capture_a"),
            F.lit(b).alias("capture_b"),
            F.col(a).alias("img_a"),
            F.col(b).alias("img_b"),
        )
        for i, a in enumerate(CAPTURE_ORDER)
        for b in CAPTURE_ORDER[i + 1 :]
    ]
    return (
        firsts.select(identity, F.explode(F.array(*pairs)).alias("_p"))
        .select(identity, "_p.*")
        .where(F.col("img_a").isNotNull() & F.col("img_b").isNotNull())
    )


def diff_pairs(
    ids: DataFrame, n_diff: int | Column, seed: int, id_col: str = "id", sides: str = "alternate"
) -> DataFrame:
    """(pair, identity_a, identity_b): unique unordered pairs of different ids.

    Ids stand on a circle in seeded order and are paired at distance 1, 2, ...; each full
    distance gives every id two more pairs, so degrees differ by at most two. Nothing of size n²
    is enumerated. ``sides`` is ``alternate`` (left and right swap) or ``sorted`` (a < b).
    """
    unique = ids.select(id_col).distinct()
    ranked = seeded_rank(unique, id_col, seed).select(
        (F.col("rank") - 1).alias("_i"), F.col(id_col).alias("_id")
    )
    n = unique.agg(F.count(F.lit(1))).scalar()
    wanted = F.lit(n_diff).cast("bigint") if isinstance(n_diff, int) else n_diff.cast("bigint")
    sized = ranked.withColumn("_n", n).withColumn(
        "_target",
        F.least(wanted, F.floor(F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint")),
    )
    full = F.floor(F.col("_target") / F.col("_n"))
    rest = F.col("_target") - full * F.col("_n")
    distances = full + F.when(F.col("_i") < rest, 1).otherwise(0)
    left = (
        sized.where(distances > 0)
        .withColumn("_d", F.explode(F.sequence(F.lit(1).cast("bigint"), distances)))
        .withColumn("_j", (F.col("_i") + F.col("_d")) % F.col("_n"))
    )
    partners = ranked.select(F.col("_i").alias("_j"), F.col("_id").alias("_partner"))
    joined = left.join(partners, "_j")
    if sides == "sorted":
        a, b = F.least("_id", "_partner"), F.greatest("_id", "_partner")
    else:
        low_first = (F.col("_i") + F.col("_j")) % 2 == 0
        keep = low_first == (F.col("_i") < F.col("_j"))
        a = F.when(keep, F.col("_id")).otherwise(F.col("_partner"))
        b = F.when(keep, F.col("_partner")).otherwise(F.col("_id"))
    return joined.select(
        ((F.col("_d") - 1) * F.col("_n") + F.col("_i") + 1).alias("pair"),
        a.alias("identity_a"),
        b.alias("identity_b"),
    )


def diff_target_clamp(n_same: Column, n_diff: Column, origin: str) -> Column:
    """Different pairs to build: into the trial bands for field data, else what exists."""
    if origin != FIELD_ORIGIN:
        return F.least(F.greatest(F.lit(0), n_diff), F.floor(n_same * (n_same - 1) / 2))

    def banded(value: Column) -> Column:
        return F.greatest(F.lit(DIFF_BAND[0]), F.least(F.lit(DIFF_BAND[1]), value))

    target = F.least(banded(n_diff), F.lit(TOTAL_BAND[1]) - n_same)
    return banded(F.greatest(target, F.lit(TOTAL_BAND[0]) - n_same))


def pair_count_bands(counts: DataFrame, origin: str) -> DataFrame:
    """(rule, message) rows for one row of n_same, n_diff that breaks the bands."""
    same, diff = F.col("n_same"), F.col("n_diff")
    if origin == FIELD_ORIGIN:
        rules = [
            ("same_band", ~same.between(*SAME_BAND), same, SAME_BAND),
            ("diff_band", ~diff.between(*DIFF_BAND), diff, DIFF_BAND),
            ("total_band", ~(same + diff).between(*TOTAL_BAND), same + diff, TOTAL_BAND),
        ]
        broken = [
            F.when(
                bad,
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.concat(value.cast("string"), F.lit(f" outside [{lo}, {hi}]")).alias("message"),
                ),
            )
            for rule, bad, value, (lo, hi) in rules
        ]
    else:
        broken = [
            F.when(
                same < 1,
                F.struct(F.lit("same_missing").alias("rule"), F.lit("no same pair").alias("message")),
            ),
            F.when(
                (diff < 1) & (same >= 2),
                F.struct(
                    F.lit("diff_missing").alias("rule"), F.lit("no different pair").alias("message")
                ),
            ),
        ]
    return (
        counts.select(F.explode(F.array(*broken)).alias("_r"))
        .where(F.col("_r").isNotNull())
        .select("_r.*")
    )


def identity_capture_pick(files: DataFrame, rel_path: str = "rel_path") -> DataFrame:
    """(identity, doc, selfie) from paths ``identity/...``.

    A subfolder with a known name comes before a file with one, names by priority. Where a side
    is missing, the first two images of the identity stand in; an identity with one image, or
    the same image twice, is left out.
    """
    parts = F.split(F.col(rel_path), "/")
    rows = files.where(F.size(parts) >= 2).select(
        parts[0].alias("identity"),
        F.col(rel_path).alias("path"),
        F.when(F.size(parts) == 3, parts[1]).alias("_folder"),
        F.when(F.size(parts) == 2, stem(F.col(rel_path))).alias("_file"),
    ).where(~F.startswith("identity", F.lit(".")))

    def best(names: Sequence[str]) -> Column:
        order = F.array(*[F.lit(n) for n in names])
        by_folder = F.array_position(order, F.col("_folder"))
        by_file = F.array_position(order, F.col("_file"))
        rank = F.when(by_folder > 0, F.struct(F.lit(0), by_folder, _path_order())).when(
            by_file > 0, F.struct(F.lit(1), by_file, _path_order())
        )
        return F.min_by("path", rank)

    picked = rows.groupBy("identity").agg(
        best(DOCUMENT_NAMES).alias("doc"), best(SELFIE_NAMES).alias("selfie")
    )
    first_two = (
        rows.withColumn(
            "_n", F.row_number().over(Window.partitionBy("identity").orderBy(_path_order()))
        )
        .where(F.col("_n") <= 2)
        .groupBy("identity")
        .agg(
            F.max(F.when(F.col("_n") == 1, F.col("path"))).alias("_one"),
            F.max(F.when(F.col("_n") == 2, F.col("path"))).alias("_two"),
        )
    )
    complete = F.col("doc").isNotNull() & F.col("selfie").isNotNull()
    return (
        picked.join(first_two, "identity")
        .select(
            "identity",
            F.when(complete, F.col("doc")).otherwise(F.col("_one")).alias("doc"),
            F.when(complete, F.col("selfie")).otherwise(F.col("_two")).alias("selfie"),
        )
        .where(F.col("selfie").isNotNull() & (F.col("doc") != F.col("selfie")))
    )


def pair_manifest(
    identities: DataFrame,
    n_diff: int | Column,
    seed: int,
    origin: str,
    captures: tuple[str, str],
    warning: str | None = None,
    sides: str = "alternate",
) -> DataFrame:
    """Same rows, then different rows, from (identity, img_a, img_b); ids number each part."""
    shared = [
        F.lit(origin).alias("origin"),
        F.lit(captures[0]).alias("capture_a"),
        F.lit(captures[1]).alias("capture_b"),
        F.lit(warning).cast("string").alias("pair_warning"),
    ]
    none = F.lit(None).cast("string")
    same = positions(identities, ["identity"]).select(
        F.concat(F.lit("fc_same_"), F.format_string("%04d", "position")).alias("id"),
        "img_a",
        "img_b",
        F.lit(True).alias("same"),
        F.col("identity").alias("identity_id"),
        none.alias("identity_a"),
        none.alias("identity_b"),
        *shared,
    )
    pairs = diff_pairs(identities, n_diff, seed, "identity", sides)
    left = identities.select(F.col("identity").alias("identity_a"), "img_a")
    right = identities.select(F.col("identity").alias("identity_b"), "img_b")
    diff = pairs.join(left, "identity_a").join(right, "identity_b").select(
        F.concat(F.lit("fc_diff_"), F.format_string("%04d", "pair")).alias("id"),
        "img_a",
        "img_b",
        F.lit(False).alias("same"),
        none.alias("identity_id"),
        "identity_a",
        "identity_b",
        *shared,
    )
    return same.unionByName(diff)


def scored_pair_sweep(
    pairs: DataFrame, groups: Sequence[str] = ("backend",), targets: dict[str, float] | None = None
) -> DataFrame:
    """Per backend: pair counts and the operating point on sensitivity and accuracy.

    Pairs without a similarity are counted and left out of the sweep; a backend without a scored
    pair is infeasible.
    """
    groups, targets = list(groups), targets or PAIR_TARGETS
    hist = score_histogram_counts(
        pairs.withColumn("label", F.col("same").cast("int")),
        groups,
        score="similarity",
        keep_missing=True,
    )
    size, missing = F.col("pos") + F.col("neg"), F.col("bucket").isNull()
    counts = hist.groupBy(*groups).agg(
        F.sum(size).alias("n"),
        F.sum(F.when(missing, 0).otherwise(size)).alias("n_scored"),
        F.sum(F.when(missing, size).otherwise(0)).alias("null_count"),
    )
    sweep = sweep_from_counts(hist, groups).withColumnRenamed("tpr", "sensitivity")
    operating = maximin_threshold(sweep, targets, groups)
    return null_safe_join(counts, operating, groups, "left").withColumn(
        "infeasible", F.coalesce("infeasible", F.lit(True))
    )
