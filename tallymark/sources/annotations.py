"""Region annotation files, in project and single-image layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.documents import base_name
from tallymark.functions.rows import explode_array, explode_values
from tallymark.schemas import ANNOTATION_REGION

# Entries stay JSON text here, in the file's order; an object of VARIANT kind would sort its keys.
_LAYOUT = "_via_img_metadata MAP<STRING, STRING>, filename STRING, regions STRING"


def annotation_entries(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., entry, file, regions VARIANT): one row per annotated image, in the file's order.

    A non-empty project map wins over top-level regions, as one file holds one layout. Entries of
    a project become rows before their regions are parsed, whatever fields those hold.
    """
    layout = F.from_json(text, _LAYOUT)
    opened = files.select(*keep, layout.alias("_l"))
    project = F.map_values("_l._via_img_metadata")
    single = F.array(
        F.to_json(F.struct(F.col("_l.filename").alias("filename"), F.lit(None).cast("string").alias("regions")))
    )
    entries = explode_array(
        opened.withColumn("_top", F.col("_l.regions")), [*keep, "_top"],
        F.when(F.size(project) > 0, project).when(F.col("_l").isNotNull(), single), "entry", "_e",
    )
    whole = F.try_parse_json("_e")
    own = F.try_variant_get(whole, "$.regions", "variant")
    return entries.select(
        *keep,
        "entry",
        F.try_variant_get(whole, "$.filename", "string").alias("file"),
        F.coalesce(own, F.try_parse_json("_top")).alias("regions"),
    )


def explode_regions(entries: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., entry, file, ordinal, shape, attrs): one row per region.

    An entry without regions keeps a row with null ordinal, shape and attrs, as its image is known.
    """
    shape = ANNOTATION_REGION["shape_attributes"].dataType.simpleString()
    found = entries.select(*keep, "entry", "file", F.expr("try_cast(regions AS ARRAY<VARIANT>)").alias("_r"))
    listed = found.select(*keep, "entry", "file", F.posexplode_outer("_r").alias("ordinal", "_region"))
    attrs = F.try_variant_get("_region", "$.region_attributes", "map<string,string>")
    bare = F.create_map().cast("map<string,string>")
    return listed.select(
        *keep,
        "entry",
        "file",
        "ordinal",
        F.try_variant_get("_region", "$.shape_attributes", shape).alias("shape"),
        F.when(F.col("ordinal").isNotNull(), F.coalesce(attrs, bare)).alias("attrs"),
    )


def annotation_read(spark: SparkSession, path: str) -> DataFrame:
    """One row per region, and per entry without one, with the annotation file it comes from."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("annotation"), F.col("value").alias("text")
    )
    return explode_regions(annotation_entries(files, ["annotation"]), ["annotation"])


def entry_for_image(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Images (annotation, code, idx, filename) with ``entry``, null for an image without one.

    An entry belongs to an image when its base name starts with the image's index, which its file
    name and ``code/name`` spellings do too; the first such entry counts. Entries are looked up by
    the prefixes of their names, so a file with many images is not paired with each of them.
    Neither side is bounded, so the join is a shuffled one: a broadcast would be chosen by the size
    of compressed files, and its rows gathered in the driver.
    """
    base = base_name(F.col("file"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length(base)), lambda n: F.substring(base, F.lit(1), n)
    )
    first = (
        # The first row stands for its entry.
        explode_values(
            regions.where((F.coalesce("ordinal", F.lit(0)) == 0) & (F.length(base) > 0)),
            ["annotation", "entry"],
            prefixes,
            "idx",
        )
        .groupBy("annotation", "idx")
        .agg(F.min("entry").alias("entry"))
    )
    return images.join(first.hint("merge"), ["annotation", "idx"], "left")


def for_images(regions: DataFrame, images: DataFrame, summary) -> DataFrame:
    """``summary(regions, keys, ordinal)`` of each image's own entry, or of its whole file.

    An image without an entry shares what its file's regions say together. They are summed up
    once per entry and once per file, and images join the one row that is theirs, by shuffles.
    """
    placed = entry_for_image(regions, images)
    named = regions.where(F.col("ordinal").isNotNull()).withColumn("_order", F.struct("entry", "ordinal"))
    own = placed.where(F.col("entry").isNotNull()).join(
        summary(named, ["annotation", "entry"], "_order").hint("merge"), ["annotation", "entry"]
    )
    lacking = placed.where(F.col("entry").isNull()).drop("entry")
    files = named.join(lacking.select("annotation").distinct().hint("merge"), "annotation", "left_semi")
    shared = lacking.join(summary(files, ["annotation"], "_order").hint("merge"), "annotation")
    return own.drop("entry").unionByName(shared)
