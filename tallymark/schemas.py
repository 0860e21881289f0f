"""Record layouts of manifests, scores and logs."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


OCR_MANIFEST = _struct(
    id=_S,
    path=_S,
    doc_type=_S,
    gt_text=_S,
    gt_fields=T.MapType(_S, _S),
    origin=_S,
    script=_S,
    capture=_S,
    source=_S,
)

FORGERY_MANIFEST = _struct(
    id=_S,
    path=_S,
    label=T.IntegerType(),
    origin=_S,
    fabrication=_S,
    source=_S,
    tamper=_S,
    mask_path=_S,
    profile=_S,
    eval_domain=_S,
    generator=_S,
)

FACE_MANIFEST = _struct(
    id=_S,
    img_a=_S,
    img_b=_S,
    same=T.BooleanType(),
    origin=_S,
    identity_id=_S,
    capture_a=_S,
    capture_b=_S,
    pair_warning=_S,
)

RESUME_MANIFEST = _struct(
    id=_S,
    path=_S,
    profiles=T.MapType(_S, _S),
    origin=_S,
    gt_discrepancies=T.ArrayType(T.MapType(_S, _S)),
    anchors=_struct(
        github_login=_S,
        public_repos=T.IntegerType(),
        repo_names=T.ArrayType(_S),
        llm_used=T.BooleanType(),
    ),
)

OCR_FIELD = _struct(value=_S, bbox=T.ArrayType(T.DoubleType()), confidence=T.DoubleType())
OCR_HYPOTHESIS = _struct(
    id=_S,
    text=_S,
    fields=T.MapType(_S, OCR_FIELD),
    doc_type=_S,
    script=_S,
    latency_ms=T.DoubleType(),
)

SCORES = _struct(id=_S, score=T.DoubleType(), latency_ms=T.DoubleType(), error=_S)

PAIR_SIMILARITY = _struct(
    id=_S, similarity=T.DoubleType(), reason=_S, backend=_S, latency_ms=T.DoubleType()
)

SOURCE_STATUS = _struct(
    person=_S, source=_S, handle=_S, status=_S, data=T.MapType(_S, _S), error=_S,
    cached=T.BooleanType(),
)

ANNOTATION_REGION = _struct(
    shape_attributes=_struct(
        name=_S,
        x=T.DoubleType(),
        y=T.DoubleType(),
        width=T.DoubleType(),
        height=T.DoubleType(),
        all_points_x=T.ArrayType(T.DoubleType()),
        all_points_y=T.ArrayType(T.DoubleType()),
    ),
    region_attributes=T.MapType(_S, _S),
)

METRIC_RESULT = _struct(
    task=_S,
    metric=_S,
    value=T.DoubleType(),
    target=T.DoubleType(),
    passed=T.BooleanType(),
    infeasible=T.BooleanType(),
    n=T.LongType(),
)
