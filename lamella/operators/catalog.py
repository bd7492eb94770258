"""Catalogue of slide files: filters, grouping into series and resolutions, frames to tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.dims import PHOTOMETRIC, WSI_CLASS, WSI_MODALITY, lookup

FORMATS = {"dcm": "dicom", "tiff": "tiff", "svs": "tiff", "vsi": "vsi", "mrxs": "mirax"}


def discover(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file extension, in lower case, is one of a slide format, with bucket and directory."""
    bucket = lookup(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), FORMATS)
    return paths.withColumns({"bucket": bucket, "dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1)}).where("bucket IS NOT NULL")


def wsi_only(files: DataFrame) -> DataFrame:
    """Whole-slide microscopy files; the comparison reaches the scan."""
    return files.where((F.col("sop_class") == WSI_CLASS) & (F.col("modality") == WSI_MODALITY))


def volume_levels(files: DataFrame) -> DataFrame:
    """Files that are pyramid levels: of type VOLUME, and no smaller than their tile (if they have one)."""
    cols, rows = F.coalesce("px_columns", F.lit(0)), F.coalesce("px_rows", F.lit(0))
    tile = F.col("tile")
    return files.where(F.contains("image_type", F.lit("VOLUME")) & (cols >= F.coalesce(tile, cols)) & (rows >= F.coalesce(tile, rows)))


def series_order(tie: list[str]) -> list[Column]:
    return [F.desc("px_columns"), *map(F.col, tie)]


def resolution_groups(levels: DataFrame, tie: list[str], keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """ord and group_no of each file of a series: only neighbours of equal size share a group."""
    order = Window.partitionBy(*keys).orderBy(*series_order(tie))
    new = (F.lag("px_columns").over(order).eqNullSafe(F.col("px_columns")) & F.lag("px_rows").over(order).eqNullSafe(F.col("px_rows"))).cast("int")
    out = levels.withColumns({"ord": F.row_number().over(order), "new": F.lit(1) - new})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("group_no", F.sum("new").over(running)).drop("new")


def level_info(grouped: DataFrame, keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """One row a group: the first file's size, resolution and syntax, and the frames of all."""
    first = ["px_columns", "px_rows", "tile", "mpp", "transfer_syntax"]
    return grouped.groupBy(*keys, "group_no").agg(*(F.min_by(c, "ord").alias(c) for c in first), F.sum(F.coalesce("n_frames", F.lit(0))).alias("n_tiles"))


def role_pick(files: DataFrame, tie: list[str], keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """For each series the path of its first thumbnail, overview and label."""
    first = {role: F.min(F.when(F.contains("image_type", F.lit(role)), F.struct(*tie, "path"))) for role in ("THUMBNAIL", "OVERVIEW", "LABEL")}
    found = files.groupBy(*keys).agg(*(c.alias(role) for role, c in first.items()))
    return found.select(*keys, *(F.col(f"{role}.path").alias(role.lower()) for role in first))


def color_space(photometric: Column, app14: Column, samples: Column) -> Column:
    """By photometric interpretation, else the JPEG's APP14 transform, else the number of samples."""
    by_app14 = F.when(app14 == 0, "RGB").when(app14.isNotNull(), "YCbCr")
    return F.coalesce(lookup(F.trim(photometric), PHOTOMETRIC), by_app14, F.when(samples == 1, "Grayscale"), F.lit("YCbCr"))


def icc_profile(optical: Column, top: Column) -> Column:
    return F.coalesce(F.when(F.length(optical) > 0, optical), F.when(F.length(top) > 0, top))


def frame_tiles(frames: DataFrame, tie: list[str], tile: int, width: int) -> DataFrame:
    """tile_index of each frame of a file: from its 1-based position, or its ordinal if any frame of the file has none."""
    across = -(-width // tile)
    by_file = Window.partitionBy("file")
    order = by_file.orderBy(*tie)
    cell = lambda c: F.expr(f"(greatest(coalesce({c}, 1), 1) - 1) div {tile}")
    out = frames.withColumns(
        {"ordinal": (F.row_number().over(order) - 1).cast("long"), "placed": F.bool_and(F.col("column_pos").isNotNull() & F.col("row_pos").isNotNull()).over(by_file)}
    )
    return out.withColumn("tile_index", F.when(F.col("placed"), cell("row_pos") * across + cell("column_pos")).otherwise(F.col("ordinal")))
