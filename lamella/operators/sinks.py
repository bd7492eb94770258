"""What output files will hold: directories, tags, names, and what is left out; and the sinks' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.dims import PHOTOMETRIC
from lamella.functions.scalars import tile_align
from lamella.operators.catalog import color_space

#: The only columns that reach an output's metadata.
PHI_SAFE = ["px_columns", "px_rows", "tile", "mpp", "transfer_syntax", "n_tiles"]
EXTENSIONS = (".tiff", ".ome.tiff", ".svs")
# Vendor compression codes of JPEG 2000 in SVS, TIFF photometric codes, and SVS image roles by position and type.
JP2_YCBCR, JP2_RGB, JPEG = 33003, 33005, 7
MINISBLACK, RGB, YCBCR = 1, 2, 6
ROLES = {"BASE": (0, 0), "THUMBNAIL": (1, 0), "LEVEL": (2, 0), "LABEL": (3, 1), "MACRO": (4, 9)}


def phi_safe(levels: DataFrame) -> DataFrame:
    """An explicit list of columns, so that a new one never leaks."""
    return levels.select(*PHI_SAFE)


def without_output(slides: DataFrame, existing: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    """Slides (stem) of which no output file (path) exists."""
    suffix = "|".join(sorted((e.replace(".", r"\.") for e in extensions), key=len, reverse=True))
    done = existing.select(F.regexp_extract("path", rf"^(.*?)(?:{suffix})$", 1).alias("stem")).where("stem <> ''").distinct()
    return slides.join(done, "stem", "left_anti")


def ifd_tags(w: Column, h: Column, tile: Column, compression: Column, samples: Column, mpp: Column) -> Column:
    """Tags that all directories share; without a known resolution there is no resolution tag."""
    known = mpp > 0
    return F.struct(
        w.alias("width"),
        h.alias("height"),
        tile_align(tile, 16).alias("tile_w"),
        tile_align(tile, 16).alias("tile_h"),
        compression.cast("int").alias("compression"),
        samples.alias("samples"),
        F.lit(8).alias("bits"),
        F.when(known, 3).alias("resolution_unit"),
        F.when(known, F.lit(1e4) / mpp).alias("x_resolution"),
    )


def svs_tags(jp2k: Column, photometric: Column, app14: Column, samples: Column) -> Column:
    """Compression and photometric code of an SVS directory."""
    space = color_space(photometric, app14, samples)
    transformed = jp2k & photometric.isin([k for k in PHOTOMETRIC if k.startswith("YBR")])
    by_space = F.when(space == "Grayscale", MINISBLACK).when(~jp2k & (space == "YCbCr"), YCBCR).otherwise(RGB)
    return F.struct(
        F.when(transformed, JP2_YCBCR).when(jp2k, JP2_RGB).otherwise(JPEG).alias("compression"),
        F.when(transformed, YCBCR).otherwise(by_space).alias("photometric"),
    )


def directory_plan(plan: DataFrame, layout: str) -> DataFrame:
    """Where each level goes: ome, all but the first as sub-directories of it; flat, one directory after another."""
    k = (F.row_number().over(Window.partitionBy("series").orderBy("level_no")) - 1).cast("long")
    out = plan.withColumn("k", k).withColumn("subfile_type", F.when(F.col("k") == 0, 0).otherwise(1))
    if layout == "flat":
        return out.withColumnRenamed("k", "ifd")
    return out.withColumns({"ifd": F.when(F.col("k") == 0, 0), "sub_ifd": F.when(F.col("k") > 0, F.col("k") - 1)}).drop("k")


def svs_plan(plan: DataFrame) -> DataFrame:
    """Base, thumbnail, further levels, label, macro: in this order."""
    first = F.min("level_no").over(Window.partitionBy("series"))
    levels = plan.select("series", F.when(F.col("level_no") == first, "BASE").otherwise("LEVEL").alias("role"), "level_no")
    extra = plan.select("series").distinct().select("series", F.explode(F.array(*map(F.lit, ["THUMBNAIL", "LABEL", "MACRO"]))).alias("role"), F.lit(None).cast("long").alias("level_no"))
    table = F.create_map(*[F.lit(x) for role, v in ROLES.items() for x in (role, v[0])])
    kind = F.create_map(*[F.lit(x) for role, v in ROLES.items() for x in (role, v[1])])
    order = Window.partitionBy("series").orderBy(table[F.col("role")], "level_no")
    return levels.unionByName(extra).withColumns({"ifd": (F.row_number().over(order) - 1).cast("long"), "subfile_type": kind[F.col("role")]})


def tiff_files(tiles: DataFrame) -> DataFrame:
    """A BigTIFF for each slide of rows (slide, dir, sub, width, height, tile, compression, photometric, samples, mpp,
    description, tile_index, data). A file is one value here, so this is for slides of up to some hundred MB; tables of
    directories and tiles have no such limit. A tile that lacks stays absent in the file."""
    import pandas as pd

    from lamella.functions.tiffout import Directory, bigtiff

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (number, sub), own in rows.groupby(["dir", "sub"], sort=True):
            head = own.iloc[0]
            count = -(-int(head["width"]) // int(head["tile"])) * -(-int(head["height"]) // int(head["tile"]))
            data = [None] * count
            for k, blob in zip(own["tile_index"], own["data"]):
                if 0 <= k < count:
                    data[int(k)] = bytes(blob) if blob is not None else None
            ints = {c: int(head[c]) for c in ("width", "height", "tile", "compression", "photometric", "samples")}
            text = head["description"] if isinstance(head["description"], str) else None
            found.append(Directory(**ints, tiles=data, subfile=int(number > 0), mpp=float(head["mpp"] or 0), sub=bool(sub), description=text))
        return pd.DataFrame({"slide": [rows["slide"].iat[0]], "content": [bigtiff(found)]})

    shape = f"slide {tiles.schema['slide'].dataType.simpleString()}, content binary"
    return tiles.groupBy("slide").applyInPandas(run, shape)
