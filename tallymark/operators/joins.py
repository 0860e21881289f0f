"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which null keys match null keys; the keys of ``left`` are kept."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    meets = F.lit(True)
    for key in keys:
        meets = meets & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, meets, how).drop(*[f"_r_{key}" for key in keys])


def hot_split_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight_col: str,
    hot_keys: int = 1000,
    write_lookup: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` with a unique-key ``lookup`` whose ``weight_col`` counts its rows.

    The ``hot_keys`` heaviest keys are joined by broadcast, which is at most ``hot_keys`` rows
    whatever the data; every other key holds at most 1/``hot_keys`` of the rows and is shuffled.
    The lookup is read three times; ``write_lookup`` computes and writes it first.
    """
    keys = list(keys)
    lookup = materialize(lookup) if write_lookup else lookup
    hot = lookup.orderBy(F.col(weight_col).desc(), *keys).limit(hot_keys)
    hot_key_set = F.broadcast(hot.select(*keys))
    cold = lookup.join(hot_key_set, keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(hot_key_set, keys, "left_anti").join(cold, keys)
    )

