"""Embedding similarity and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.rows import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_to_unit(cosine: Column) -> Column:
    """[-1, 1] to [0, 1], clipped."""
    return clamp01((cosine + 1.0) / 2.0)


def cosine_unit(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None):
    """Similarity in [0, 1]; null when either vector is missing."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return bind(F.try_divide(dot(a, b), na * nb), cosine_to_unit)


def missing_reason(reason_a: Column, reason_b: Column) -> Column:
    """Reasons of both sides joined by ';'."""
    joined = F.concat_ws(";", F.nullif(reason_a, F.lit("")), F.nullif(reason_b, F.lit("")))
    return F.when(joined == "", "no_face_detected").otherwise(joined)


def clamp01(score: Column) -> Column:
    """Into [0, 1]; a missing score stays missing (least and greatest skip nulls)."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def array_mean(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(a).cast("double"))


def top_tenth_mean(a: Column) -> Column:
    """Mean of the largest tenth of the values (at least one)."""
    k = F.greatest(F.lit(1), F.floor(F.size(a) / 10).cast("int"))
    return array_mean(F.slice(F.sort_array(a, asc=False), F.lit(1), k))


def score_fusion(det: Column, probs: Column) -> dict[str, Column]:
    """Detector score, pooled map scores and their fixed mixes."""
    mean, peak, top = array_mean(probs), F.array_max(probs).cast("double"), top_tenth_mean(probs)
    return {
        "det": det,
        "loc_mean": mean,
        "loc_max": peak,
        "loc_topk10": top,
        "fuse_mean": det * 0.5 + mean * 0.5,
        "fuse_max": det * 0.5 + peak * 0.5,
        "fuse_topk": det * 0.5 + top * 0.5,
        "fuse_max70": det * 0.3 + peak * 0.7,
    }


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def decode_data_url(text: Column) -> Column:
    """``data:...base64,`` payload (or bare base64) to binary; null when it does not decode."""
    trimmed = F.trim(text)
    is_data_url = F.startswith(trimmed, F.lit("data:")) & F.contains(trimmed, F.lit("base64,"))
    payload = F.when(
        is_data_url, F.element_at(F.split(trimmed, "base64,", 2), 2)
    ).otherwise(trimmed)
    return F.try_to_binary(payload, F.lit("base64"))
