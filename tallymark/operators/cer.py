"""Field character error rates: per field, per record, and broken down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import text as tx
from tallymark.functions.fields import field_lookup
from tallymark.functions.rows import explode_map
from tallymark.operators.ordering import indexed_totals

def explode_gt_fields(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., field, ref) per ground-truth field; null values are dropped."""
    return explode_map(records, keep, "gt_fields", "field", "ref").where(F.col("ref").isNotNull())


def page_window_rows(rows: DataFrame, page: str = "page", ref: str = "ref") -> DataFrame:
    """Adds ``cer`` and ``hyp`` of the best page window, within the row whatever the page's length."""
    found = rows.withColumn("_found", tx.best_window_cer(F.col(page), F.col(ref)))
    return found.withColumns({"cer": F.col("_found.cer"), "hyp": F.col("_found.span")}).drop("_found")


def _compared(exploded: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., field, cer, gt, hyp, match) of rows with hyp_fields and page; no shuffle."""
    value = exploded.withColumn("_hyp", field_lookup(F.col("hyp_fields"), F.col("field")))
    searched = (F.col("_hyp") == "") & (F.coalesce("page", F.lit("")) != "")
    direct = F.struct(tx.cer(F.col("_hyp"), F.col("ref")).alias("cer"), F.col("_hyp").alias("span"))
    found = value.select(
        *keep,
        "field",
        "ref",
        searched.alias("_searched"),
        F.when(searched, tx.best_window_cer(F.col("page"), F.col("ref"))).otherwise(direct).alias("_found"),
    )
    return found.select(
        *keep,
        "field",
        F.col("_found.cer").alias("cer"),
        F.col("ref").alias("gt"),
        F.col("_found.span").alias("hyp"),
        F.when(F.col("_searched"), "page_window").otherwise("fields").alias("match"),
    )


def field_rows(records: DataFrame, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., field, cer, gt, hyp, match) per ground-truth field, in one pass.

    ``records`` holds gt_fields and hyp_fields (MAP<STRING, STRING>) and page. The value comes
    from the same key, from the first key equal in lower case, or from the page.
    """
    kept = [id_col, *keep]
    return _compared(explode_gt_fields(records, [*kept, "hyp_fields", "page"]), kept)


def record_items(records: DataFrame, keep: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """(id, keep..., cer_field, n_fields) of every record, in one pass and one shuffle by id.

    ``cer_field`` is null, and ``n_fields`` 0, for a record without ground-truth fields; of equal
    ids the first one's other columns are kept.
    """
    exploded = records.select(
        id_col, *keep, "hyp_fields", "page", F.explode_outer("gt_fields").alias("field", "ref")
    )
    rows = _compared(exploded, [id_col, *keep])
    weight = F.when(F.col("gt").isNotNull(), F.greatest(F.length("gt"), F.lit(1)).cast("double"))
    return rows.groupBy(id_col).agg(
        *[F.first(c).alias(c) for c in keep],
        (F.sum(F.col("cer") * weight) / F.sum(weight)).alias("cer_field"),
        F.count("gt").alias("n_fields"),
    )


def cer_micro(rows: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Per record: errors weighted by reference length, an empty reference counting 1."""
    weight = F.greatest(F.length("gt"), F.lit(1)).cast("double")
    return rows.groupBy(*keys).agg(
        (F.sum(F.col("cer") * weight) / F.sum(weight)).alias("cer_field"),
        F.count(F.lit(1)).alias("n_fields"),
    )


def record_cer(records: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Every record with its ``cer_field``, null for a record without ground-truth fields."""
    return records.join(cer_micro(rows, [id_col]), id_col, "left")


def cer_macro(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.avg("cer_field").alias("cer_field"),
        F.count(F.lit(1)).alias("n"),
        F.count("cer_field").alias("n_with_gt_fields"),
    )


def cer_breakdown(
    items: DataFrame,
    lang_by_country: dict[str, str] | None = None,
    default_lang: str = "en",
    row_index: str = "row_index",
) -> DataFrame:
    """Overall, by script and by country in one pass: (level, key, ..., script, lang_code_used).

    A country reports the script of its first record.
    """
    known = items.select(
        F.coalesce("script", F.lit("unknown")).alias("script"),
        F.coalesce("country", F.lit("unknown")).alias("country"),
        "cer_field",
        F.col(row_index).alias("_row"),
    ).withColumn("_script", F.col("script"))
    grouped = known.groupingSets([[], ["script"], ["country"]], "script", "country").agg(
        F.grouping("script").alias("_gs"),
        F.grouping("country").alias("_gc"),
        F.avg("cer_field").alias("cer_field"),
        F.count(F.lit(1)).alias("n"),
        F.count("cer_field").alias("n_with_gt_fields"),
        F.min_by("_script", "_row").alias("_first_script"),
    )
    by_script, by_country = F.col("_gs") == 0, F.col("_gc") == 0
    return grouped.select(
        F.when(by_script, "script").when(by_country, "country").otherwise("overall").alias("level"),
        F.when(by_script, F.col("script")).when(by_country, F.col("country")).otherwise("")
        .alias("key"),
        "cer_field",
        "n",
        "n_with_gt_fields",
        F.when(by_country, F.col("_first_script")).alias("script"),
        F.when(by_country, tx.lang_used(F.col("country"), lang_by_country or {}, default_lang))
        .alias("lang_code_used"),
    )


def running_cer(
    items: DataFrame, keys: Sequence[str] = (), row_index: str = "row_index",
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Adds ``running_cer_field``: mean over the records so far, nulls left out."""
    totals = indexed_totals(
        items,
        row_index,
        {
            "_sum": F.coalesce("cer_field", F.lit(0.0)),
            "_count": F.when(F.col("cer_field").isNotNull(), 1).otherwise(0).cast("bigint"),
        },
        keys,
        chunk_rows,
    )
    return totals.withColumn(
        "running_cer_field", F.try_divide(F.col("_sum"), F.col("_count").cast("double"))
    ).drop("_sum", "_count")


def scope_filter(
    records: DataFrame, scripts: Sequence[str] | None = None, countries: Sequence[str] | None = None
) -> DataFrame:
    """Keep records whose script and country are allowed, whatever the letter case."""
    script, country = scope_columns()
    kept = records
    if scripts:
        kept = kept.where(F.lower(script).isin(*[s.lower() for s in scripts]))
    if countries:
        kept = kept.where(F.lower(country).isin(*[c.lower() for c in countries]))
    return kept


def scope_columns() -> tuple[Column, Column]:
    """(script, country) of a record: own value, else from the document type, else unknown."""
    doc_type = F.col("doc_type")
    return (
        F.coalesce(F.col("script"), tx.script_of(doc_type), F.lit("unknown")),
        F.coalesce(tx.country_of(doc_type), F.lit("unknown")),
    )


class EmptyScopeError(ValueError):
    """The scope filter removed every record."""


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyScopeError("the scope filter removed every record")
    return df
