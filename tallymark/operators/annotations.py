"""Region annotations and raw OCR blocks to fields, boxes and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.documents import region_name, region_value
from tallymark.functions.geometry import flat_to_box
from tallymark.functions.rows import explode_array
from tallymark.functions.text import gt_text_join, script_of
from tallymark.sources.annotations import for_images

FACE_FIELDS = ("face", "photo", "portrait")


def field_map_build(regions: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """(keys..., fields): name to value, the last duplicate wins, in order of first appearance."""
    keys = list(keys)
    named = regions.select(
        *keys,
        ordinal,
        region_name(F.col("attrs")).alias("_name"),
        region_value(F.col("attrs")).alias("_value"),
    ).where(
        F.col("_name").isNotNull()
        & F.col("_value").isNotNull()
        & ~F.lower("_name").isin(*FACE_FIELDS)
    )
    last = named.groupBy(*keys, "_name").agg(
        F.max_by("_value", F.col(ordinal)).alias("_value"), F.min(ordinal).alias("_first")
    )
    # One entry per distinct field name of a form.
    return last.groupBy(*keys).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_first", "_name", "_value"))),
                lambda e: F.struct(e["_name"], e["_value"]),
            )
        ).alias("fields")
    )


def _face_name(attrs: Column) -> Column:
    lowered = F.transform_keys(attrs, lambda k, _: F.lower(k))
    parts = [
        F.nullif(F.try_element_at(lowered, F.lit(k)), F.lit(""))
        for k in ("field_name", "name", "type")
    ]
    return F.lower(F.coalesce(*parts, F.lit("")))


def region_box(shape: Column) -> Column:
    """[x, y, width, height] around a polygon of three or more points, or of a rectangle."""

    def whole(values: Column) -> Column:
        return F.transform(values, lambda v: v.cast("bigint"))

    # A rectangle's four corners and a polygon's points are boxed the same way: both pixel
    # edges count, so the box is one wider than the span.
    n = F.least(F.size(shape["all_points_x"]), F.size(shape["all_points_y"]))
    xs, ys = whole(shape["all_points_x"]), whole(shape["all_points_y"])
    polygon = F.when(
        n >= 3,
        F.array(
            F.array_min(xs),
            F.array_min(ys),
            F.array_max(xs) - F.array_min(xs) + 1,
            F.array_max(ys) - F.array_min(ys) + 1,
        ),
    )
    zero = F.lit(0.0)
    x, y, w, h = (
        F.coalesce(shape[c], zero).cast("bigint") for c in ("x", "y", "width", "height")
    )
    rect = F.array(x, y, w + 1, h + 1)
    return F.when(shape["name"] == "polygon", polygon).when(shape["name"] == "rect", rect)


def face_region_box(regions: DataFrame, keys: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """(keys..., face_box): box of the first face-named polygon or rectangle."""
    boxed = regions.where(F.contains(_face_name(F.col("attrs")), F.lit("face"))).withColumn(
        "_box", region_box(F.col("shape"))
    )
    return (
        boxed.where(F.col("_box").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("_box", F.col(ordinal)).alias("face_box"))
    )


def image_fields(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Images (annotation, code, idx, filename) with the field map of their regions."""
    return for_images(regions, images, field_map_build)


def image_face_boxes(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Images (annotation, code, idx, filename) with the box of their first face region."""
    return for_images(regions, images, face_region_box)


def template_field_join(
    captures: DataFrame, templates: DataFrame, keys: Sequence[str] = ("code", "idx")
) -> DataFrame:
    """Captures with the fields and text of their template; none gives an empty map and ''."""
    empty = F.create_map().cast("map<string,string>")
    # No hint: a template table of unknown size is broadcast only if measured small at run time.
    side = templates.select(*keys, "fields")
    return (
        captures.join(side, list(keys), "left")
        .withColumn("gt_fields", F.coalesce("fields", empty))
        .drop("fields")
        .withColumn("gt_text", gt_text_join(F.col("gt_fields")))
    )


def ocr_manifest_build(captures: DataFrame, templates: DataFrame, source: str) -> DataFrame:
    """Scan and photo captures (code, idx, capture, suffix) to OCR manifest rows."""
    code, idx = F.col("code"), F.col("idx")
    name = F.concat_ws("_", F.col("capture"), code, idx)
    return template_field_join(captures, templates).select(
        F.concat(F.lit("ocr_"), name).alias("id"),
        F.concat(F.lit("img/"), name, F.lower("suffix")).alias("path"),
        code.alias("doc_type"),
        "gt_text",
        "gt_fields",
        F.lit("public_dataset").alias("origin"),
        "capture",
        F.lit(source).alias("source"),
        script_of(code).alias("script"),
    )


# --- raw OCR results -------------------------------------------------------------------------

_BLOCK = (
    "STRUCT<label: STRING, block_label: STRING, type: STRING, content: STRING,"
    " block_content: STRING, text: STRING, bbox: STRING, block_bbox: STRING,"
    " coordinate: STRING, box: STRING, score: DOUBLE, confidence: DOUBLE>"
)
_BLOCK_LIST_KEYS = ("parsing_res_list", "layout_det_res", "boxes", "blocks")
_WRAPPER = f"STRUCT<res: STRING, {', '.join(f'{k}: STRING' for k in _BLOCK_LIST_KEYS)}>"
_UNBOXED_TEXT_LABELS = ("ocr", "text", "block")


def _is_list(json_text: Column) -> Column:
    return F.startswith(json_text, F.lit("["))


def _blocks_json(results: DataFrame, id_col: str, raw: str) -> DataFrame:
    """(id, blocks): JSON text of the block list, which is bare or under one of the known keys.

    An object that holds only ``res`` is unwrapped first, up to twice. Each level is parsed once.
    """
    levels = results.select(
        id_col, F.ltrim(raw).alias("_text"), F.from_json(raw, _WRAPPER).alias("_level")
    )
    for _ in range(2):
        wrapped = F.col("_level.parsing_res_list").isNull() & F.startswith("_level.res", F.lit("{"))
        inner = F.when(wrapped, F.from_json("_level.res", _WRAPPER))
        levels = levels.select(id_col, "_text", F.coalesce(inner, F.col("_level")).alias("_level"))
    found = [F.when(_is_list(F.col("_text")), F.col("_text"))]
    for key in _BLOCK_LIST_KEYS:
        value = F.col(f"_level.{key}")
        found.append(F.when(_is_list(value) & (F.regexp_replace(value, r"\s", "") != "[]"), value))
        nested = F.get_json_object(value, "$.boxes")
        found.append(F.when(F.startswith(value, F.lit("{")) & _is_list(nested), nested))
    return levels.select(id_col, F.coalesce(*found).alias("blocks"))


def _numbers(json_text: Column) -> Column:
    """Flat list of the numbers of a (possibly nested) JSON array."""
    flat = F.from_json(json_text, "ARRAY<DOUBLE>")
    nested = F.flatten(F.from_json(json_text, "ARRAY<ARRAY<DOUBLE>>"))
    is_nested = F.regexp_like(json_text, F.lit(r"^\s*\[\s*\["))
    return F.when(is_nested, nested).otherwise(flat)


def _filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def ocr_block_normalize(results: DataFrame, id_col: str = "id", raw: str = "raw") -> DataFrame:
    """(id, idx, name, value, bbox, confidence) of each block of raw layout-parser JSON.

    A block without a box has no value, except plain text blocks, which get the unit box.
    """
    listed = F.from_json("blocks", f"ARRAY<{_BLOCK}>")
    blocks = explode_array(_blocks_json(results, id_col, raw), [id_col], listed, "idx", "b")
    label = F.coalesce(_filled(F.col("b.label"), F.col("b.block_label"), F.col("b.type")), F.lit("block"))
    content = F.trim(F.coalesce("b.content", "b.block_content", "b.text"))
    box_text = F.coalesce(
        *[F.when(F.col(f"b.{c}") != "[]", F.col(f"b.{c}")) for c in ("bbox", "block_bbox", "coordinate", "box")]
    )
    score = F.coalesce(F.nullif("b.score", F.lit(0.0)), F.col("b.confidence"))
    unit = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    kept_text = F.lower(label).isin(*_UNBOXED_TEXT_LABELS) & (content != "")
    return blocks.select(
        id_col,
        "idx",
        F.concat(label, F.lit("_"), F.format_string("%03d", "idx")).alias("name"),
        content.alias("_content"),
        _numbers(box_text).alias("_coords"),
        F.coalesce(kept_text, F.lit(False)).alias("_kept"),
        score.alias("confidence"),
    ).withColumn("_bbox", flat_to_box(F.col("_coords"))).select(
        id_col,
        "idx",
        "name",
        F.when(F.col("_bbox").isNotNull(), F.nullif("_content", F.lit("")))
        .when(F.col("_kept"), F.col("_content"))
        .alias("value"),
        F.when(F.col("_bbox").isNotNull(), F.col("_bbox")).when(F.col("_kept"), unit).alias("bbox"),
        "confidence",
    )


_LINE_LISTS = (
    "STRUCT<rec_texts: ARRAY<STRING>, texts: ARRAY<STRING>, rec_scores: ARRAY<DOUBLE>,"
    " scores: ARRAY<DOUBLE>, rec_polys: ARRAY<ARRAY<ARRAY<DOUBLE>>>,"
    " dt_polys: ARRAY<ARRAY<ARRAY<DOUBLE>>>, rec_boxes: ARRAY<ARRAY<DOUBLE>>>"
)
_LINE_ITEM = (
    "STRUCT<transcription: STRING, text: STRING, rec_text: STRING, score: DOUBLE,"
    " confidence: DOUBLE, rec_score: DOUBLE, points: ARRAY<ARRAY<DOUBLE>>,"
    " box: ARRAY<ARRAY<DOUBLE>>, dt_polys: ARRAY<ARRAY<DOUBLE>>>"
)


def _some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def ocr_line_normalize(results: DataFrame, id_col: str = "id", raw: str = "raw") -> DataFrame:
    """(id, idx, name, value, bbox, confidence) of each line of raw text-recogniser JSON.

    Three layouts: an object of parallel lists (possibly inside ``res``), a list of line objects,
    and a list of [box, [text, score]] pairs, the last two possibly one page list deeper.
    """
    text = F.coalesce(F.get_json_object(F.col(raw), "$.res"), F.col(raw))
    page = F.when(F.regexp_like(text, F.lit(r"^\s*\[\s*\[\s*\{")), F.get_json_object(text, "$[0]")).otherwise(text)
    lists = F.from_json(F.when(F.regexp_like(page, F.lit(r"^\s*\{")), page), _LINE_LISTS)
    texts = F.coalesce(_some(lists["rec_texts"]), lists["texts"])
    scores = F.coalesce(_some(lists["rec_scores"]), lists["scores"])
    polys = F.coalesce(_some(lists["rec_polys"]), lists["dt_polys"])
    boxes = lists["rec_boxes"]

    def from_lists(t: Column, i: Column) -> Column:
        return F.struct(
            t.alias("text"),
            F.get(scores, i).alias("confidence"),
            F.coalesce(F.flatten(F.get(polys, i)), F.get(boxes, i)).alias("coords"),
        )

    items = F.from_json(
        F.when(F.regexp_like(page, F.lit(r"^\s*\[\s*\{")), page), f"ARRAY<{_LINE_ITEM}>"
    )

    def from_item(e: Column) -> Column:
        return F.struct(
            _filled(e["transcription"], e["text"], e["rec_text"]).alias("text"),
            F.coalesce(
                F.nullif(e["score"], F.lit(0.0)), F.nullif(e["confidence"], F.lit(0.0)), e["rec_score"]
            ).alias("confidence"),
            F.flatten(F.coalesce(_some(e["points"]), _some(e["box"]), e["dt_polys"])).alias("coords"),
        )

    # [box, [text, score]]: both members are kept as JSON text and parsed on their own.
    pair_page = F.when(
        F.regexp_like(page, F.lit(r"^\s*\[\s*\[\s*\[\s*\[\s*\[")), F.get_json_object(page, "$[0]")
    ).otherwise(page)
    pairs = F.from_json(
        F.when(F.regexp_like(page, F.lit(r"^\s*\[\s*\[\s*\[")), pair_page), "ARRAY<ARRAY<STRING>>"
    )

    def from_pair(e: Column) -> Column:
        payload = F.from_json(F.get(e, F.lit(1)), "ARRAY<STRING>")
        return F.struct(
            F.get(payload, F.lit(0)).alias("text"),
            F.get(payload, F.lit(1)).try_cast("double").alias("confidence"),
            F.flatten(F.from_json(F.get(e, F.lit(0)), "ARRAY<ARRAY<DOUBLE>>")).alias("coords"),
        )

    lines = F.coalesce(
        F.transform(texts, from_lists), F.transform(items, from_item), F.transform(pairs, from_pair)
    )
    read = F.filter(lines, lambda x: x["text"].isNotNull())
    exploded = explode_array(results, [id_col], read, "idx", "line")
    xs = F.filter("line.coords", lambda _, i: i % 2 == 0)
    ys = F.filter("line.coords", lambda _, i: i % 2 == 1)
    box = F.when(
        (F.size("line.coords") >= 4) & (F.size("line.coords") % 2 == 0),
        F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )
    return exploded.select(
        id_col,
        "idx",
        F.format_string("line_%03d", "idx").alias("name"),
        F.when(box.isNotNull(), F.col("line.text")).alias("value"),
        box.alias("bbox"),
        F.col("line.confidence").alias("confidence"),
    )
