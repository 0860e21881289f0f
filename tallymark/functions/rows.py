"""Arrays and maps to rows, evaluating the array once.

A plain explode of a computed array makes the optimizer add a non-empty filter that computes the
array a second time, below every projection it can pass. The outer form has no such filter, and
dropping its empty rows afterwards gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


Named = Sequence[str | Column]


def explode_array(df: DataFrame, keep: Named, array: str | Column, position: str, value: str):
    """(keep..., position, value) per element."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(
        F.col(position).isNotNull()
    )


def explode_values(df: DataFrame, keep: Named, array: str | Column, value: str) -> DataFrame:
    """(keep..., value) per element."""
    return explode_array(df, keep, array, "_position", value).drop("_position")


def explode_map(df: DataFrame, keep: Named, entries: str | Column, key: str, value: str):
    """(keep..., key, value) per entry."""
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).where(F.col(key).isNotNull())
