"""Hand-computed values of scalars, kernels and options."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.config import JobConfig
from lamella.functions import scalars as S
from lamella.functions.jpeg import resize_plane
from lamella.functions.xml import updated_xml
from lamella.operators import catalog as C
from lamella.operators import kernels as K
from lamella.operators import planner as P
from lamella.operators import tiles as T


def each(spark, make, values, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("r")).orderBy("i")
    return [r.r for r in rows.collect()]


def test_rounding(spark):
    assert each(spark, S.factor_to_20x, [-1.0, 0.0, 0.199, 0.2, 0.299, 0.3, 0.699, 0.7]) == [None, None, 4, 2, 2, 1, 1, None]
    assert each(spark, lambda v: S.tile_align(v, 16), [0, 1, 16, 17], "bigint") == [0, 16, 16, 32]
    assert each(spark, S.nearest_16, [0.0, 7.9, 8.0, 23.9, 24.0, 120.0, 240.0]) == [16, 16, 16, 16, 32, 128, 240]


def test_resolution(spark):
    row = spark.range(1).select(
        S.dicom_mpp(F.lit(50.0), F.lit(50.0), F.lit(200000), F.lit(None).cast("string"), 2).alias("a"),
        S.dicom_mpp(F.lit(None).cast("double"), F.lit(1.0), F.lit(100), F.lit("0.0005\\0.00025"), 2).alias("b"),
        S.dicom_mpp(F.lit(1.0), F.lit(None).cast("double"), F.lit(100), F.lit("0.0005\\0.00025"), 1).alias("c"),
        S.tiff_mpp(F.lit(40000.0), F.lit(40000.0), F.lit(3)).alias("d"),
        S.tiff_mpp(F.lit(101600.0), F.lit(101600.0), F.lit(2)).alias("e"),
        S.tiff_mpp(F.lit(40000.0), F.lit(40000.0), F.lit(1)).alias("f"),
    ).first()
    assert [row.a, row.b, row.c, row.d, row.f] == [0.25, 0.25, 0.5, 0.25, 0.0] and math.isclose(row.e, 0.25)


def test_texts(spark):
    assert each(spark, S.description_mpp, ["lib v1|AppMag = 40|MPP = 0.2498", "lib\nMPP = 0.5"], "string") == [0.2498, None]
    assert each(spark, lambda v: S.xml_attribute(v, "SizeX"), ['<P PhysicalSizeX="0.5" SizeX="7">'], "string") == ["7"]
    assert each(spark, S.xml_escape, ['a<b & "c"'], "string") == ["a&lt;b &amp; &quot;c&quot;"]
    names = ["../../etc/passwd", "a b?c.dcm", "..hidden", "", ".."]
    assert each(spark, S.sanitize_stem, names, "string") == ["passwd", "abc.dcm", "hidden", "unnamed", "unnamed"]
    assert each(spark, S.unit_um, ["nm", "mm", "furlong"], "string") == [0.001, 1000.0, None]
    xml = '<Pixels SizeX="1" SizeY="2" PhysicalSizeX="9" IFD="3"/>'
    new = each(spark, lambda v: updated_xml(v, F.lit(70), F.lit(80), F.lit(0.5), F.lit(0.25)), [xml], "string")[0]
    assert new == '<Pixels SizeX="70" SizeY="80" PhysicalSizeX="0.500000" IFD="0"/>'


def test_colours(spark):
    assert each(spark, S.fill_rgb, [16744512, None], "bigint") == [(255, 128, 64), (255, 255, 255)]
    cases = {(255, 128, 128): (255, 255, 255), (0, 128, 128): (0, 0, 0), (128, 255, 128): (128, 84, 255), (128, 128, 255): (255, 37, 128), (76, 85, 255): (254, 0, 0)}
    df = spark.createDataFrame(list(cases), "y int, cb int, cr int")
    got = {(r.y, r.cb, r.cr): tuple(r.c) for r in df.select("*", K.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr")).alias("c")).collect()}
    assert got == cases


def test_islands(spark):
    sizes = [(4096, 3072), (4096, 3072), (1024, 768), (1024, 700), (1024, 768)]
    df = spark.createDataFrame([(1, w, h, i) for i, (w, h) in enumerate(sizes)], "series int, px_columns long, px_rows long, i int")
    groups = [r["count"] for r in C.resolution_groups(df, ["i"]).groupBy("group_no").count().orderBy("group_no").collect()]
    assert groups == [2, 1, 1, 1]


LEVEL = "series int, group_no long, px_columns long, px_rows long, tile long, mpp double, transfer_syntax string, n_tiles long"
JPEG, JP2K = "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.90"


@pytest.mark.parametrize(
    "levels, tiff, want",
    [
        ([(4096, 0.25, JPEG), (1024, 1.0, JPEG)], False, [(2048, 0.5, 256), (512, 2.0, 256)]),
        ([(4096, 0.25, JP2K), (2048, 0.5, JP2K)], False, [(1024, 1.0, 256), (1024, 1.0, 256)]),
    ],
)
def test_level_plan(spark, levels, tiff, want):
    df = spark.createDataFrame([(1, i + 1, w, w, 256, m, t, 1) for i, (w, m, t) in enumerate(levels)], LEVEL)
    plan = P.plan_levels(df, F.lit(0.5), F.lit(1), tiff=tiff).orderBy("level_no").collect()
    assert [(r.out_w, r.actual_mpp, r.out_tile) for r in plan] == want


def test_rounding_order(spark):
    df = spark.createDataFrame([(1, 1, 4096, 4096, 240, 0.25, "", 1)], LEVEL)
    tile = lambda tiff: P.plan_levels(df, F.lit(0.5), F.lit(0), tiff=tiff).first().out_tile
    assert (tile(False), tile(True)) == (240, 256)


def test_pyramids(spark):
    grid = F.array(F.struct(F.lit(4608).alias("w"), F.lit(4096).alias("h")), F.struct(F.lit(2560).alias("w"), F.lit(2048).alias("h")))
    levels = spark.range(1).select(P.halving_levels(F.lit(4097), F.lit(4096), grid).alias("l")).first().l
    assert [tuple(x) for x in levels] == [(4097, 4096), (2049, 2048)]
    sides = each(spark, lambda v: F.transform(P.doubling_levels(v, F.lit(10), F.lit(1.0)), lambda d: F.round(v / d)), [5000], "bigint")[0]
    assert sides == [5000, 2500, 1250, 625, 313]


def test_places(spark):
    trees = spark.createDataFrame([(1, 0, "A", 3), (1, 1, "B", 2), (1, 2, "P", 1), (2, 0, "A", 3)], "slide int, i int, name string, count int")
    assert {r.slide: r.record for r in T.prefix_before(trees, "P").collect()} == {1: 5, 2: -1}
    grid = spark.range(1).select(T.regular_grid(3, 2, 256, 2, 10, 10).alias("g")).first().g
    assert [tuple(g) for g in grid] == [(0, 0, 0), (1, 502, 0), (2, 0, 502)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["﻿k = 0", ";c", "[A]", "k = v=1", "k=2"])], "f int, line_no int, line string")
    assert {(r.section, r.key): r.value for r in T.ini_pairs(lines, ["f"]).collect()} == {("", "k"): "0", ("A", "k"): "2"}


def test_frames(spark):
    df = spark.createDataFrame([(1, 0, 257, 513), (2, 0, 0, 0), (3, 0, 1, 1), (3, 1, None, 1)], "file int, n int, column_pos int, row_pos int")
    got = {(r.file, r.ordinal): r.tile_index for r in C.frame_tiles(df, ["n"], 256, 1000).collect()}
    assert got == {(1, 0): 9, (2, 0): 0, (3, 0): 0, (3, 1): 1}


@pytest.mark.parametrize("kernel", ["nearest", "triangle", "catmullrom", "lanczos3", "gaussian"])
def test_kernels(kernel):
    for row in K.kernel_weights(kernel, 16, 5):
        assert math.isclose(sum(w for _, w in row), 1)
    flat = np.full((9, 12, 3), 77, np.uint8)
    assert (resize_plane(flat, 4, 5, kernel) == 77).all()
    assert K.kernel_weights("gaussian", 16, 5) == K.kernel_weights("lanczos3", 16, 5)


def test_options():
    assert JobConfig("in", "out", scale="HALF").scale_kind == ("half", None)
    assert JobConfig("in", "out", scale="0.5", kernel="Bicubic").scale_kind == ("mpp", 0.5)
    for bad in ({"scale": "3"}, {"scale": "x"}, {"quality": 10}, {"jobs": 0}, {"kernel": "box"}):
        with pytest.raises(ValueError):
            JobConfig("in", "out", **bad)
    with pytest.raises(ValueError):
        JobConfig("a.tif", "out")
    assert JobConfig("a.svs", "out").input_dir == "a.svs"
