"""Planning and text functions on columns; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.functions.dims import UNIT_UM, lookup


def ceil_div(value: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return F.floor((value + by - 1) / by).cast("long")


def tile_align(value: Column, multiple: int) -> Column:
    """Rounded up to a multiple."""
    return ceil_div(value, multiple) * multiple


def nearest_16(value: Column) -> Column:
    """The nearest multiple of 16, halves away from zero, 16 at least."""
    return (F.greatest(F.round(value / 16), F.lit(1.0)) * 16).cast("long")


def factor_to_20x(mpp: Column) -> Column:
    """By how much a slide is to be halved and halved again to be at 20x; null if it can't be."""
    return F.when(mpp <= 0, None).when(mpp < 0.2, 4).when(mpp < 0.3, 2).when(mpp < 0.7, 1)


def dicom_mpp(volume_mm: Column, other_volume_mm: Column, pixels: Column, spacing: Column, part: int) -> Column:
    """Micrometres a pixel along one axis: volume size over pixels; if it or the other axis' lacks, the pixel spacing
    (`row\\column`, in mm; part 2 for x, 1 for y), if that has two numbers."""
    own = volume_mm * 1000 / pixels
    numbers = F.filter(F.transform(F.split(spacing, r"\\"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(volume_mm.isNotNull() & other_volume_mm.isNotNull() & pixels.isNotNull(), own).when(F.size(numbers) >= 2, F.get(numbers, F.lit(part - 1)) * 1000).otherwise(own)


def tiff_mpp(resolution: Column, other: Column, unit: Column) -> Column:
    """Micrometres a pixel of a TIFF resolution: unit 3 is cm, 2 is inch; 0 if it can't be told."""
    unit = F.coalesce(unit, F.lit(3))
    known = (resolution > 0) & (other > 0)
    return F.when(~F.coalesce(known, F.lit(False)), 0.0).when(unit == 3, F.lit(1e4) / resolution).when(unit == 2, F.lit(25400.0) / resolution).otherwise(0.0)


def n_reduce(shift: Column, tile_w: Column, tile_h: Column, half_w: Column, half_h: Column) -> Column:
    """Halvings left to the decoder: the shift if exact, else the whole powers of two in the scale."""
    scale = F.least(tile_w / half_w, tile_h / half_h)
    return F.when(shift > 0, shift).when(scale > 1, F.floor(F.log2(scale))).otherwise(0).cast("int")


def app_mag(objective: Column, mpp: Column) -> Column:
    """Objective power, or what the resolution makes likely."""
    return F.coalesce(objective, F.round(F.lit(0.25) / F.coalesce(mpp, F.lit(0.25)) * 40))


def fill_rgb(value: Column) -> Column:
    """struct<r, g, b> of an integer with blue in its low byte; white if null."""
    byte = lambda k: F.coalesce(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255)), F.lit(255)).cast("int")
    return F.struct(byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def bytes_per_sample(pixel_type: Column) -> Column:
    return F.when(pixel_type.isin(3, 4), 2).when(pixel_type.isin(5, 6, 9), 4).when(pixel_type.isin(7, 8, 10), 8).otherwise(1)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_attribute(text: Column, name: str) -> Column:
    """The first value of an attribute of exactly this name; "" if there is none."""
    return F.regexp_extract(text, f'(?:^|[^A-Za-z0-9_]){name}="([^"]*)"', 1)


def xml_attribute_replaced(text: Column, name: str, value: Column) -> Column:
    """text with the first such attribute's value replaced; unchanged if there is none."""
    found = F.regexp_extract(text, f'(?s)^(.*?(?:^|[^A-Za-z0-9_]){name}=")[^"]*".*$', 1)
    rest = F.substring(text, F.length(found) + 1, F.length(text))
    return F.when(found == "", text).otherwise(F.concat(found, value, F.regexp_replace(rest, r'(?s)^[^"]*', "")))


def description_mpp(text: Column) -> Column:
    """MPP of a description whose parts are divided by |."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.trim(p))
    values = F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit("MPP = "))), lambda p: F.trim(F.substring(p, 7, 1000)).try_cast("double"))
    return F.get(F.filter(values, lambda v: v > 0), F.lit(0))


def unit_um(unit: Column) -> Column:
    return lookup(unit, UNIT_UM)


def physical_size(xml: Column) -> Column:
    """struct<x, y>: micrometres a pixel in OME-XML; X is needed, Y is X by default, null unless positive."""
    size = lambda axis: F.nullif(xml_attribute(xml, f"PhysicalSize{axis}"), F.lit("")).try_cast("double")
    unit = lambda axis: unit_um(F.coalesce(F.nullif(xml_attribute(xml, f"PhysicalSize{axis}Unit"), F.lit("")), F.lit("µm")))
    x = size("X") * unit("X")
    y = F.coalesce(size("Y") * unit("Y"), x)
    fine = (x > 0) & (y > 0)
    return F.struct(F.when(fine, x).alias("x"), F.when(fine, y).alias("y"))


def sanitize_stem(name: Column) -> Column:
    """A safe file stem: the last path component's letters, digits and -_. without leading dots."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    kept = F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}_.\-]", ""), r"^\.+", "")
    return F.when(kept == "", "unnamed").otherwise(kept)


def tiff_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"\.ome$", "")


def ome_type(bits: Column) -> Column:
    return F.when(bits == 16, "uint16").when(bits == 32, "uint32").otherwise("uint8")


def _moment(days: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(days.cast("long") * 86400 + seconds.cast("long"))


def epoch_stamp(days: Column, seconds: Column) -> Column:
    """YYYYMMDD_HHMMSS in UTC, by the true calendar."""
    return F.date_format(_moment(days, seconds), "yyyyMMdd_HHmmss")


def epoch_text(days: Column, seconds: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS in UTC, by the true calendar."""
    return F.date_format(_moment(days, seconds), "yyyy-MM-dd HH:mm:ss")


def shown_name(number: Column, name: Column, width: int = 52) -> Column:
    """`(number) name`, in `width` characters at most: of a longer name the tail, after an ellipsis."""
    prefix = F.concat(F.lit("("), number.cast("string"), F.lit(")"))
    room = F.greatest(F.lit(width - 1) - F.length(prefix), F.lit(0))
    tail = F.concat(F.lit("…"), F.right(name, F.greatest(room - 1, F.lit(0))))
    return F.concat(prefix, F.lit(" "), F.when(F.length(name) > room, tail).otherwise(name))
