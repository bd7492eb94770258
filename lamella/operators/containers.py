"""Slides of several files: which files belong to an index, their bytes, and where a conversion of them starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.scalars import factor_to_20x


def _stem(path: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def stream_files(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """index, n, path, length of the tile streams `frame*.ets`, at any depth, below the sibling folder `_<stem>_` of each index
    (path); n is 1, 2, 3, ... by path, compared a component at a time. files are (path, length). A file is looked up under
    each of its own folders, so its rows are bounded by its depth."""
    parts = F.split("path", "/")
    found = files.where(F.col("path").rlike(r"/frame[^/]*\.ets$")).select("path", "length", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("at", "folder"))
    found = found.where(F.col("folder").rlike("^_.+_$"))
    owner = F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), F.col("at")), F.expr("substring(folder, 2, length(folder) - 2)"))
    found = found.select(owner.alias("stem"), "path", "length")
    owned = indexes.select(F.col("path").alias("index"), _stem("path").alias("stem")).join(found, "stem").drop("stem")
    return owned.withColumn("n", F.row_number().over(Window.partitionBy("index").orderBy(F.split("path", "/"))).cast("long"))


def stream_bytes(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """path, in_bytes of each index (path, length): its own bytes and those of its tile streams."""
    streams = stream_files(indexes, files).groupBy(F.col("index").alias("path")).agg(F.sum("length").alias("more"))
    return indexes.join(streams, "path", "left").select("path", (F.col("length") + F.coalesce("more", F.lit(0))).alias("in_bytes"))


def folder_bytes(markers: DataFrame, files: DataFrame) -> DataFrame:
    """path, in_bytes of each marker (path, length): its own bytes and those of the files directly in the folder of its name."""
    held = files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("stem")).agg(F.sum("length").alias("more"))
    own = markers.select("path", "length", _stem("path").alias("stem"))
    return own.join(held, "stem", "left").select("path", (F.col("length") + F.coalesce("more", F.lit(0))).alias("in_bytes"))


def tiled_only(levels: DataFrame) -> DataFrame:
    """Levels whose tile size is known."""
    return levels.where("tile_w IS NOT NULL AND tile_h IS NOT NULL")


def filled(fragments: DataFrame, data: str = "data") -> DataFrame:
    """Fragments that hold bytes; the others keep their place in the order, so ordinals have gaps."""
    return fragments.where(F.length(data) > 0)


def first_profile(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profile: the first profile, in order of group_no, of the groups (tile_w, tile_h, jpeg, profile) that can be copied:
    of known tile size, and, if JPEG, of sides that 16 divides. Null if none has one."""
    aligned = (F.col("tile_w") % 16 == 0) & (F.col("tile_h") % 16 == 0)
    usable = F.col("tile_w").isNotNull() & F.col("tile_h").isNotNull() & (~F.col("jpeg") | aligned) & F.col("profile").isNotNull()
    return groups.groupBy(*keys).agg(F.min_by("profile", F.when(usable, F.col("group_no"))).alias("profile"))


def start_resolution(scale: Column, mpp: Column) -> Column:
    """Halvings before the first level of a streamed slide; null where 20x can't be reached. Other scales start at 0."""
    return F.when(scale == "quarter", 2).when(scale == "half", 1).when(scale == "20x", F.log2(factor_to_20x(mpp)).cast("int")).otherwise(0)


def base_downsample(scale: Column, target: Column, mpp: Column) -> Column:
    """Factor between captures and the first level; null where 20x can't be reached. A target resolution counts only if the
    slide's is known and finer."""
    to_target = F.when((mpp > 0) & (target > mpp), target / mpp).otherwise(1.0)
    preset = F.when(scale == "quarter", 4.0).when(scale == "half", 2.0).when(scale == "20x", factor_to_20x(mpp).cast("double")).otherwise(1.0)
    return F.when(target.isNotNull(), to_target).otherwise(preset)
