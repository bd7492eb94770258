"""Which levels to write, from which source, and how: decisions as columns, no data read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.functions.dims import EXACT_HALVING, JP2K_CODES, JPEG2000, JPEG_TAG, compression_tag

MIN_SIDE, CLOSE = 512, 0.1


def shift_of(factor: Column) -> Column:
    """How many halvings a factor of 1, 2 or 4 is."""
    return F.when(factor == 4, 2).when(factor == 2, 1).otherwise(0)


def scale_decision(mpp: Column, kind: str, number: float | None = None) -> Column:
    """struct<target, shift, status> for one slide. kind: 20x, half, quarter, mpp (with number) or none."""
    known = F.when(mpp > 0, mpp)
    none, zero = F.lit(None).cast("double"), F.lit(0)
    if kind in ("half", "quarter"):  # an unknown resolution counts as 1
        shift = 1 if kind == "half" else 2
        target, shift_, status = F.coalesce(known, F.lit(1.0)) * 2**shift, F.lit(shift), F.lit("RESAMPLE")
    elif kind == "20x":
        factor = S.factor_to_20x(known)
        target, shift_ = F.when(factor > 1, known * factor), F.when(factor > 1, shift_of(factor)).otherwise(zero)
        status = F.when(factor.isNull(), "SKIP").when(factor == 1, "PASSTHROUGH").otherwise("RESAMPLE")
    elif kind == "mpp":
        wanted = F.lit(float(number))
        ok = (wanted > known) & (F.abs(wanted - known) / known >= CLOSE)
        target, shift_ = F.when(ok, wanted), zero
        status = F.when(ok, "RESAMPLE").otherwise("PASSTHROUGH")
    else:
        target, shift_, status = none, zero, F.lit("PASSTHROUGH")
    return F.struct(target.cast("double").alias("target"), shift_.cast("int").alias("shift"), status.alias("status"))


def route_action(mpp: Column, has_profile: Column, kind: str, bake: bool, number: float | None = None) -> Column:
    """What becomes of a TIFF: copy, skip, bake (colours only) or resample; the first rule that holds decides."""
    factor = S.factor_to_20x(mpp)
    rules: list[tuple[Column, str]] = []
    if bake:
        rules.append((~has_profile, "copy"))
    if kind == "20x":
        rules += [(factor.isNull(), "skip"), (factor == 1, "bake" if bake else "copy")]
    if kind == "none":
        rules.append((F.lit(True), "bake" if bake else "untouched"))
    if kind == "mpp":
        rules += [(mpp <= 0, "error"), (F.lit(float(number)) <= mpp, "bake" if bake else "skip")]
    out = F.lit("resample")
    for test, action in reversed(rules):
        out = F.when(test, action).otherwise(out)
    return out


def plan_levels(levels: DataFrame, target: Column, shift: Column, bake: bool = False, tiff: bool = False, keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """The output levels of each slide, from rows (keys, group_no, px_columns, px_rows, tile, mpp, transfer_syntax,
    n_tiles) and its target and shift columns.

    Each output level takes the source level nearest to its target, the first of equally near ones. It is copied if
    within a tenth of it, JPEG and aligned; else resampled, halved exactly where the decoder can, else to tiles of a
    multiple of 16: of the whole output tile, or (tiff) of the half of it. A slide's levels are one array, so neither a
    join nor a second shuffle is needed."""
    level = F.struct("group_no", "px_columns", "px_rows", "tile", "mpp", "transfer_syntax", "n_tiles")
    slides = levels.withColumns({"_target": target, "_shift": shift}).groupBy(*keys).agg(F.sort_array(F.collect_list(level)).alias("levels"), F.first("_target").alias("target"), F.first("_shift").alias("shift"))
    slides = slides.where("target IS NOT NULL").withColumn("base_mpp", F.col("levels")[0].mpp)
    out = slides.select(*keys, "target", "shift", "base_mpp", "levels", F.explode("levels").alias("own"))
    out = out.withColumn("level_target", F.col("target") * (F.col("own.mpp") / F.col("base_mpp")))
    near = F.array_min(F.transform("levels", lambda x: F.struct(F.abs(x.mpp - F.col("level_target")).alias("gap"), x.group_no.alias("group_no"), x.alias("src"))))
    out = out.withColumn("src", near.src).select(*keys, "shift", "level_target", F.col("own.group_no").alias("level_no"), "src.*")
    tag = compression_tag(F.col("transfer_syntax"))
    passthrough = (F.abs(F.col("mpp") - F.col("level_target")) / F.col("level_target") < CLOSE) & (tag == JPEG_TAG) & (F.col("tile") % 16 == 0) & F.lit(not bake)
    exact = (F.col("shift") > 0) & ((tag.isin(JPEG_TAG, *JP2K_CODES)) if tiff else F.col("transfer_syntax").isin(EXACT_HALVING))
    divisor = F.expr("shiftleft(1L, shift)")
    halved = F.greatest(S.ceil_div(F.col("tile"), divisor), F.lit(1).cast("long"))
    natural = F.col("tile") * F.col("mpp") / F.col("level_target")
    rounded = S.nearest_16(natural) if tiff else F.greatest(F.floor(S.nearest_16(natural * 2) / 2).cast("long"), F.lit(1).cast("long"))
    out = out.withColumns({"passthrough": passthrough, "half": F.when(exact, halved).otherwise(rounded)})
    scaled = lambda c: F.round(F.col(c) * (F.col("half") / F.col("tile"))).cast("long")
    out = out.select(
        *keys,
        "level_no",
        F.col("group_no").alias("src_no"),
        "passthrough",
        F.when(F.col("passthrough"), F.col("px_columns")).otherwise(scaled("px_columns")).alias("out_w"),
        F.when(F.col("passthrough"), F.col("px_rows")).otherwise(scaled("px_rows")).alias("out_h"),
        F.when(F.col("passthrough"), F.col("tile")).otherwise(F.col("half") * 2).alias("out_tile"),
        F.when(F.col("passthrough"), F.col("mpp")).otherwise(F.col("mpp") * F.col("tile") / F.col("half")).alias("actual_mpp"),
        "level_target",
        "n_tiles",
    )
    out = out.where(F.greatest("out_w", "out_h") >= MIN_SIDE)
    tiles = S.ceil_div(F.col("out_w"), F.col("out_tile")) * S.ceil_div(F.col("out_h"), F.col("out_tile"))
    return out.withColumns({"out_tiles": F.when(F.col("passthrough"), F.col("n_tiles")).otherwise(tiles), "overscaled": F.col("actual_mpp") > F.col("level_target") * 1.5}).drop("n_tiles")


def jp2k_skip(levels: DataFrame, target: float, keys: list[str] = ["series"]) -> DataFrame:  # noqa: B006
    """For slides in JPEG 2000: how many leading levels are finer than the target, if the next one is near it."""
    slides = levels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("group_no", "mpp", "transfer_syntax"))).alias("levels"))
    finer = F.transform("levels", lambda x: F.coalesce(x.mpp, F.lit(1e308)) < target * 0.9)
    skip = (F.coalesce(F.nullif(F.array_position(finer, F.lit(False)), F.lit(0).cast("long")), F.size("levels") + 1) - 1).cast("int")
    slides = slides.withColumn("skip", skip)
    fits = F.abs(F.get("levels", F.col("skip")).mpp - target) / target < CLOSE
    ok = F.col("levels")[0].transfer_syntax.isin(JPEG2000) & (F.col("skip") > 0) & F.coalesce(fits, F.lit(False))
    return slides.select(*keys, F.when(ok, F.col("skip")).alias("skip"))


def output_name(stem: Column, scaled: Column, jp2k: Column, skip: Column, openslide: bool) -> Column:
    """The output's file name."""
    svs = skip.isNotNull() | (~scaled & jp2k) if openslide else F.lit(False)
    return F.concat(S.sanitize_stem(stem), F.when(svs, ".svs").when(F.lit(openslide), ".tiff").otherwise(".ome.tiff"))


def halving_levels(width: Column, height: Column, extents: Column) -> Column:
    """Sizes of a pyramid by halving: array of struct<w, h>, as many as extents (array of struct<w, h>: what the tiles of
    each resolution reach) or up to the first empty one. The first extent replaces a missing base. An odd side rounds up
    where the tiles reach further, and no side goes beyond them."""
    start = F.struct(F.coalesce(F.when(width > 0, width), extents[0].w).alias("w"), F.coalesce(F.when(height > 0, height), extents[0].h).alias("h"))

    def step(done: Column, extent: Column) -> Column:
        last = F.element_at(done, -1)

        def side(name: str) -> Column:
            half = F.shiftright(last[name], 1)
            return F.when((last[name] % 2 == 1) & (half < extent[name]), half + 1).otherwise(F.least(half, extent[name]))

        return F.concat(done, F.array(F.struct(side("w").alias("w"), side("h").alias("h"))))

    every = F.aggregate(F.slice(extents, 2, F.greatest(F.size(extents) - 1, F.lit(0))), F.array(start), step)
    empty = F.array_position(F.transform(every, lambda x: (x.w <= 0) | (x.h <= 0)), F.lit(True)).cast("int")
    return F.when(empty > 1, F.slice(every, 1, empty - 1)).otherwise(every)


def doubling_levels(width: Column, height: Column, downsample: Column, least: int = MIN_SIDE) -> Column:
    """Downsampling factors d, 2d, 4d, ... of a pyramid, to the first one below `least` pixels, itself included."""
    side = lambda k: F.round(F.greatest(width, height) / (downsample * F.pow(F.lit(2.0), k)))
    steps = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: (k == 0) | (side(k - 1) >= least))
    return F.transform(steps, lambda k: downsample * F.pow(F.lit(2.0), k))
