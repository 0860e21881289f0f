"""OCR field maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_fields(fields: Column) -> Column:
    """MAP<STRING, STRUCT<value, bbox, ...>> to MAP<STRING, STRING>, keeping located values."""
    located = F.map_filter(
        fields, lambda _, f: f["bbox"].isNotNull() & f["value"].isNotNull()
    )
    return F.transform_values(located, lambda _, f: f["value"])


def unwrap_bare(fields: Column) -> Column:
    """MAP<STRING, STRING> of bare values: nulls dropped."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())


def field_lookup(fields: Column, key: Column) -> Column:
    """Value under ``key``; if blank, under the first key equal in lower case; else ''."""
    exact = F.coalesce(F.try_element_at(fields, key), F.lit(""))
    same_letters = F.filter(
        F.map_entries(fields), lambda e: F.lower(e["key"]) == F.lower(key)
    )
    loose = F.coalesce(F.get(same_letters, F.lit(0)).getField("value"), F.lit(""))
    return F.when(exact != "", exact).otherwise(loose)


def bbox_backed_text(fields: Column, text: Column) -> Column:
    """Located values joined by newline; the given text only if there are none."""
    values = F.transform(
        F.filter(
            F.map_values(fields),
            lambda f: f["bbox"].isNotNull() & f["value"].isNotNull(),
        ),
        lambda f: f["value"],
    )
    return F.when(F.size(values) > 0, F.array_join(values, "\n")).otherwise(
        F.coalesce(text, F.lit(""))
    )


def bbox_fields(fields: Column) -> Column:
    """Bare string fields have no box, so value, box and confidence become null."""
    empty = F.struct(
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("array<double>").alias("bbox"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return F.transform_values(fields, lambda _, v: empty)
