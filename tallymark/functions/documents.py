"""File names to document keys, and annotation attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixedvalues import DATASET_TAGS, SOURCE_ID_PATTERN


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot belongs to the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def in_directory(path: Column, name: str) -> Column:
    return F.array_contains(F.split(path, r"[/\\]"), name)


def document_key(
    path: Column,
    source: Column | None = None,
    label: Column | None = None,
    source_pattern: str = SOURCE_ID_PATTERN,
) -> Column:
    """Document a file derives from: manifest source, manifest label, then the file name."""
    name = stem(path)
    candidates = []
    if source is not None:
        candidates.append(
            F.when(F.nullif(source, F.lit("")).isNotNull() & ~source.isin(*DATASET_TAGS),
                   stem(source))
        )
    if label is not None:
        candidates.append(F.when(label == 0, name))
        candidates.append(
            F.when(F.startswith(name, F.lit("fg_auth_")), F.substr(name, F.lit(4)))
        )
    candidates.append(F.when(in_directory(path, "authentic"), name))
    candidates.append(
        F.nullif(F.regexp_extract(name, source_pattern, 1), F.lit(""))
    )
    return F.coalesce(*candidates)


def first_filled(attrs: Column, *keys: str, keep_blank_last: bool = False) -> Column:
    """First non-blank value among ``keys``; optionally the last one even when blank."""
    values = [F.try_element_at(attrs, F.lit(k)) for k in keys]
    filled = [F.nullif(v, F.lit("")) for v in values]
    return F.coalesce(*filled, values[-1]) if keep_blank_last else F.coalesce(*filled)


def region_name(attrs: Column) -> Column:
    return first_filled(attrs, "field_name", "name", "field", "key")


def region_value(attrs: Column) -> Column:
    return first_filled(attrs, "value", "field_value", "text", keep_blank_last=True)
