"""Tiles: grids, quads, placements, overlaps, last-wins and first-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.workspace import Workspace

CELL = 512


def quads(tiles: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """One row for each 2 x 2 block with a tile: quad array of four payloads in row order, null where one lacks. The block
    is computed on the tiles' side, so there is one shuffle and no join."""
    slot = F.col("cy") % 2 * 2 + F.col("cx") % 2
    return (
        tiles.withColumns({"slot": slot, "oc": F.shiftright("cx", 1), "orow": F.shiftright("cy", 1)})
        .groupBy(*keys, "oc", "orow")
        .agg(F.array(*(F.max(F.when(F.col("slot") == k, F.col(payload))) for k in range(4))).alias("quad"))
    )


def last_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of rows with one key the value of the last."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def chunks(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Number of the run of `size` rows that each row is in, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(n / size).cast("long"))


def numbered(rows: DataFrame, group: str, order: str, name: str = "n") -> DataFrame:
    """1, 2, 3, ... within each group in an order without ties, also where a group holds most rows: rows are sorted in
    ranges, and what each range holds before the next one is summed from one row for each range and group."""
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_at", place)
    sorted_ = sorted_.withColumn("_part", F.shiftright("_at", 33))
    sorted_ = Workspace(rows.sparkSession, "numbered").save(sorted_)  # sorted once: other ranges would give other numbers
    per = sorted_.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    out = sorted_.join(per, [group, "_part"])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def shared_first(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row's value is either its group's first one (shared: stripped) or its own."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("shared", F.col(value).eqNullSafe(first))


def plane_index(chunk_rows: DataFrame, pyramid: bool) -> DataFrame:
    """The last chunk of each (stream, res, x, y) in the first plane: coordinates between x, y and the resolution are 0."""
    coord = F.col("coord")
    middle = F.slice(coord, 3, F.greatest(F.size(coord) - (3 if pyramid else 2), F.lit(0)))
    res = F.greatest(F.element_at(coord, -1), F.lit(0)) if pyramid else F.lit(0)
    plane = chunk_rows.where(F.forall(middle, lambda x: x == 0))
    at = {"res": res, "x": F.greatest(coord[0], F.lit(0)), "y": F.greatest(coord[1], F.lit(0))}
    return plane.withColumns(at).groupBy("stream", "res", "x", "y").agg(F.max("chunk").alias("chunk"))


def extents(plane: DataFrame) -> DataFrame:
    """Largest tile numbers of each resolution."""
    return plane.groupBy("stream", "res").agg(F.max("x").alias("mx"), F.max("y").alias("my"))


def grid_fill(plane: DataFrame, tile: int) -> DataFrame:
    """Every cell up to the extent, with its chunk or null (background)."""
    reach = extents(plane)
    cells = reach.select("stream", "res", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx").cast("long"))).alias("x"), "my")
    cells = cells.select("stream", "res", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("my").cast("long"))).alias("y"))
    return cells.join(plane.withColumns({c: F.col(c).cast("long") for c in "xy"}), ["stream", "res", "x", "y"], "left")


def background(color: Column, samples: int) -> Column:
    """A pixel of the background: its colour, or white if that is all zero."""
    zero = F.forall(color, lambda c: c == 0)
    return F.when(F.coalesce(zero, F.lit(True)), F.array_repeat(F.lit(255), samples)).otherwise(color)


def positional_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """left with right's row of the same number within a key, if both have as many; else with nulls."""
    number = lambda d: d.withColumns({"n": F.row_number().over(Window.partitionBy(*keys).orderBy(order)), "total": F.count("*").over(Window.partitionBy(*keys))})
    return number(left).join(number(right).drop(order), [*keys, "n", "total"], "left").drop("total")


def placed(entries: DataFrame, positions: DataFrame, images_x: int, images_y: int, tile: int, div: int) -> DataFrame:
    """Captures (slide, image_index) with their pixel place: the camera position's, plus the place within the camera image."""
    across = -(-images_x // div)
    out = entries.withColumns({"gx": F.col("image_index") % images_x, "gy": F.floor(F.col("image_index") / images_x)})
    out = out.where((F.col("gy") >= 0) & (F.col("gy") < images_y) & (F.col("gx") >= 0))
    out = out.withColumns({"xp": F.floor(F.col("gx") / div), "yp": F.floor(F.col("gy") / div)}).withColumn("cp", F.col("yp") * across + F.col("xp"))
    out = out.join(positions, ["slide", "cp"]).where("NOT (px = 0 AND py = 0 AND (xp <> 0 OR yp <> 0))")
    return out.withColumns({"place_x": F.col("px") + tile * (F.col("gx") % div), "place_y": F.col("py") + tile * (F.col("gy") % div)})


def regular_grid(count: int, across: int, tile: int, div: int, overlap_x: float, overlap_y: float) -> Column:
    """array of struct<cp, px, py>: positions on an ideal grid."""
    step_x, step_y = tile * div - overlap_x, tile * div - overlap_y
    at = lambda i: F.struct(i.cast("long").alias("cp"), F.round(i % across * step_x).cast("long").alias("px"), F.round(F.floor(i / across) * step_y).cast("long").alias("py"))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)


def normalized(places: DataFrame, tile: str = "size") -> DataFrame:
    """Places from the origin on, and the canvas that holds them."""
    slide = Window.partitionBy("slide")
    out = places.withColumns({"x": F.col("x") - F.min("x").over(slide), "y": F.col("y") - F.min("y").over(slide)})
    return out.withColumns({"width": F.max(F.col("x") + F.col(tile)).over(slide), "height": F.max(F.col("y") + F.col(tile)).over(slide)})


def covered_cells(places: DataFrame, downsample: Column | float = 1.0, cell: int = CELL) -> DataFrame:
    """A row for each output cell that a placement touches, clamped to the grid; x, y, w in output pixels. Rows per
    placement are bounded by its size, so the spatial join is an explode."""
    d = F.lit(downsample) if isinstance(downsample, float) else downsample
    scaled = lambda c: F.round(F.col(c) / d).cast("long")
    out = places.withColumns({"sx": scaled("x"), "sy": scaled("y"), "sw": F.greatest(scaled("size"), F.lit(1)), "iw": F.greatest(scaled("width"), F.lit(1)), "ih": F.greatest(scaled("height"), F.lit(1))})
    last = lambda side: F.floor((F.col(side) + cell - 1) / cell) - 1
    clamp = lambda v, side: F.least(F.floor(F.greatest(v, F.lit(0)) / cell), last(side)).cast("long")
    out = out.withColumn("cx", F.explode(F.sequence(clamp(F.col("sx"), "iw"), clamp(F.col("sx") + F.col("sw") - 1, "iw"))))
    out = out.withColumn("cy", F.explode(F.sequence(clamp(F.col("sy"), "ih"), clamp(F.col("sy") + F.col("sw") - 1, "ih"))))
    return out.select("slide", "cx", "cy", "seq", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sw").alias("size"))


def prefix_before(trees: DataFrame, name: str) -> DataFrame:
    """For each slide the sum of counts before the first tree of that name; -1 if there is none."""
    before = F.coalesce(F.sum("count").over(Window.partitionBy("slide").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = trees.withColumn("before", before).groupBy("slide").agg(F.min_by(F.col("before"), F.when(F.col("name") == name, F.col("i"))).alias("record"), F.bool_or(F.col("name") == name).alias("there"))
    return first.select("slide", F.when(F.col("there"), F.col("record")).otherwise(-1).cast("long").alias("record"))


def ini_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(section, key, value) of INI lines (keys, line_no, line): the last of equal keys wins, lines before a section are in ""."""
    text = F.trim(F.regexp_replace("line", "^﻿", ""))
    out = lines.withColumn("t", F.btrim(text, F.lit(" \t\r\n"))).where("t <> '' AND NOT startswith(t, ';')")
    head = F.when(F.col("t").rlike(r"^\[.*\]$"), F.substring(F.col("t"), 2, F.length("t") - 2))
    out = out.withColumn("head", head)
    running = Window.partitionBy(*keys).orderBy("line_no")
    out = out.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(running), F.lit(""))).where("head IS NULL AND instr(t, '=') > 0")
    out = out.withColumns({"key": F.trim(F.substring_index("t", "=", 1)), "value": F.trim(F.substring(F.col("t"), F.instr("t", "=") + 1, F.length("t")))})
    return out.groupBy(*keys, "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def page_hops(pages: DataFrame) -> DataFrame:
    """slide, page, hop of pages (slide, page, next) that a first one leads to, one to which no other points. Each round
    doubles the stretch that a page looks back, so a chain of n pages takes log2(n) joins."""
    work = Workspace(pages.sparkSession, "pages")
    before = pages.where("next IS NOT NULL").select("slide", F.col("next").alias("page"), F.col("page").alias("back"))
    state = pages.select("slide", "page").join(before, ["slide", "page"], "left")
    state = work.save(state.withColumn("hop", F.when(F.col("back").isNull(), 0).otherwise(1).cast("long")), "hops")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if not state.where("back IS NOT NULL").limit(1).count():
            break
        far = state.select("slide", F.col("page").alias("back"), F.col("back").alias("further"), F.col("hop").alias("more"))
        old = state
        state = work.save(state.join(far, ["slide", "back"], "left").select("slide", "page", F.col("further").alias("back"), (F.col("hop") + F.coalesce("more", F.lit(0))).alias("hop")), "hops")
        work.drop(old)
    return state.where("back IS NULL").select("slide", "page", "hop")  # a circle never comes to a first page
