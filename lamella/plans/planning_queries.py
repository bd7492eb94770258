"""Queries of scalars, text functions, TIFF metadata and planning decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.functions import xml as M
from lamella.functions.dims import UNIT_UM
from lamella.operators import planner as P
from lamella.operators import sinks as K
from lamella.plans import catalog_queries as Q
from lamella.plans import fixtures as X
from lamella.plans.registry import query, table

_PART = "SELECT p_partkey AS id, p_size, p_retailprice FROM part"


@query("tile_rounding", "SELECT p_partkey AS id, ((p_size * 7 + 15) // 16 * 16)::BIGINT AS aligned, (greatest(round(p_retailprice / 7 / 16), 1) * 16)::BIGINT AS nearest FROM part")
def tile_rounding(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.tile_align(F.col("p_size") * 7, 16).alias("aligned"), S.nearest_16(F.col("p_retailprice") / 7).alias("nearest"))


@query("mag_bucket", "SELECT p_partkey AS id, CASE WHEN m <= 0 THEN NULL WHEN m < 0.2 THEN 4 WHEN m < 0.3 THEN 2 WHEN m < 0.7 THEN 1 END AS factor FROM (SELECT p_partkey, (p_size - 5) / 50.0::DOUBLE AS m FROM part)")
def mag_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.factor_to_20x((F.col("p_size") - 5) / F.lit(50.0)).alias("factor"))


@query("n_reduce", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 WHEN s > 1 THEN floor(log2(s))::INT ELSE 0 END::INT AS n FROM (SELECT p_partkey, p_size, least(256.0::DOUBLE / p_size, 240.0::DOUBLE / (p_size + 3)) AS s FROM part)")
def n_reduce(spark, sf_dir):
    size = F.col("p_size")
    shift = F.when(size % 4 == 0, size % 3 + 1).otherwise(0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.n_reduce(shift, F.lit(256.0), F.lit(240.0), size, size + 3).alias("n"))


@query("tile_totals", f"WITH {X.D1_SQL} SELECT series, sum(((px_columns + tile - 1) // tile) * ((px_rows + tile - 1) // tile))::BIGINT AS tiles FROM d1 GROUP BY series")
def tile_totals(spark, sf_dir):
    grid = S.ceil_div(F.col("px_columns"), F.col("tile")) * S.ceil_div(F.col("px_rows"), F.col("tile"))
    return X.slide_files(spark, sf_dir).groupBy("series").agg(F.sum(grid).alias("tiles"))


@query("fill_color", "SELECT o_orderkey AS id, coalesce((v >> 16) & 255, 255)::INT AS r, coalesce((v >> 8) & 255, 255)::INT AS g, coalesce(v & 255, 255)::INT AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 7919) % 16777216 END AS v FROM orders)")
def fill_color(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 7919 % 16777216)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.fill_rgb(value).alias("c")).select("id", "c.*")


@query("epoch_format", "SELECT o_orderkey AS id, strftime(TIMESTAMP '1970-01-01' + to_days((o_custkey * 37 % 40000)::INT) + to_seconds(o_orderkey % 86400), '%Y%m%d_%H%M%S') AS stamp FROM orders")
def epoch_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.epoch_stamp(F.col("o_custkey") * 37 % 40000, F.col("o_orderkey") % 86400).alias("stamp"))


@query("sanitize_stem", r"""SELECT page_id AS id, CASE WHEN kept = '' THEN 'unnamed' ELSE kept END AS stem, regexp_replace(CASE WHEN kept = '' THEN 'unnamed' ELSE kept END || CASE WHEN page_id % 3 = 0 THEN '.ome' ELSE '' END, '\.ome$', '') AS tiff_stem
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^\p{L}\p{N}_.\-]', '', 'g'), '^\.+', '') AS kept FROM pages)""")
def sanitize_stem(spark, sf_dir):
    stem = S.sanitize_stem(F.col("url"))
    suffix = F.when(F.col("page_id") % 3 == 0, ".ome").otherwise("")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), stem.alias("stem"), S.tiff_stem(F.concat(stem, suffix)).alias("tiff_stem"))


@query("xml_escape", "SELECT page_id AS id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(S.xml_escape(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("xml_attr_extract", """SELECT page_id AS id, regexp_extract(html, '(?:^|[^A-Za-z0-9_])href="([^"]*)"', 1) AS href, regexp_extract(html, '(?:^|[^A-Za-z0-9_])class="([^"]*)"', 1) AS class FROM pages""")
def xml_attr_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), S.xml_attribute(F.col("html"), "href").alias("href"), S.xml_attribute(F.col("html"), "class").alias("class"))


@query("xml_attr_replace", """SELECT page_id AS id, md5(regexp_replace(html, '(^|[^A-Za-z0-9_])href="[^"]*"', '\\1href="' || page_id || '"')) AS html_md5 FROM pages""")
def xml_attr_replace(spark, sf_dir):
    new = S.xml_attribute_replaced(F.col("html"), "href", F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(new.cast("binary")).alias("html_md5"))


_OME_PARTS = "SELECT o_orderkey AS id, 1000 + o_custkey AS w, 900 + o_orderkey AS h, o_orderkey % 8 / 8.0::DOUBLE + 0.125 AS mpp, 1 + o_custkey % 2 * 2 AS spp, o_orderkey % 3 AS k, o_orderpriority AS maker FROM orders"


@query("ome_xml_dicom", f"WITH p AS ({_OME_PARTS}) SELECT id, md5(" + M.dicom_xml_sql() + ") AS xml_md5 FROM p")
def ome_xml_dicom(spark, sf_dir):
    rows = _ome_rows(spark, sf_dir)
    xml = M.dicom_xml(F.col("w"), F.col("h"), F.col("mpp"), F.col("mpp"), F.when(F.col("k") == 1, 16).when(F.col("k") == 2, 12).otherwise(8), F.col("spp"), F.when(F.col("k") != 0, F.concat(F.col("maker"), F.lit(" & <co>"))))
    return rows.select("id", F.md5(xml.cast("binary")).alias("xml_md5"))


@query("ome_xml_tiff", f"WITH p AS ({_OME_PARTS}) SELECT id, md5(" + M.tiff_xml_sql() + ") AS xml_md5 FROM p")
def ome_xml_tiff(spark, sf_dir):
    xml = M.tiff_xml(F.concat(F.col("maker"), F.lit(' "a&b"')), F.col("w"), F.col("h"), F.col("mpp"), F.col("mpp"), F.col("spp"))
    return _ome_rows(spark, sf_dir).select("id", F.md5(xml.cast("binary")).alias("xml_md5"))


def _ome_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "1000 + o_custkey AS w", "900 + o_orderkey AS h", "o_orderkey % 8 / 8.0D + 0.125D AS mpp", "1 + o_custkey % 2 * 2 AS spp", "o_orderkey % 3 AS k", "o_orderpriority AS maker")


# TIFF metadata

_DIRS = f"d AS (SELECT l_orderkey AS slide, l_orderkey % 3 = 0 AND l_linenumber >= 5 AS sub, l_quantity % 5 <> 0 AS tiled, row_number() OVER (PARTITION BY l_orderkey, l_orderkey % 3 = 0 AND l_linenumber >= 5 ORDER BY {', '.join(X.TIE)}) - 1 AS dir, l_partkey AS width FROM lineitem)"


@query("tiff_level_scan", f"""WITH {_DIRS}, s AS (SELECT *, bool_or(NOT sub AND dir = 0 AND tiled) OVER w AS fine, bool_or(sub) OVER w AS has_sub FROM d WINDOW w AS (PARTITION BY slide))
SELECT slide, CASE WHEN sub THEN 'sub' ELSE 'main' END AS chain, dir, width FROM s WHERE fine AND tiled AND (NOT has_sub OR sub OR dir = 0)""")
def tiff_level_scan(spark, sf_dir):
    """The directories that are the pyramid: the first, and its sub-directories or else the other tiled ones."""
    sub = F.expr("l_orderkey % 3 = 0 AND l_linenumber >= 5")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), sub.alias("sub"), (F.col("l_quantity") % 5 != 0).alias("tiled"), F.col("l_partkey").alias("width"), *X.TIE)
    rows = rows.withColumn("dir", (F.row_number().over(Window.partitionBy("slide", "sub").orderBy(*X.TIE)) - 1).cast("long"))
    slide = Window.partitionBy("slide")
    rows = rows.withColumns({"fine": F.bool_or(F.expr("NOT sub AND dir = 0 AND tiled")).over(slide), "has_sub": F.bool_or("sub").over(slide)})
    return rows.where("fine AND tiled AND (NOT has_sub OR sub OR dir = 0)").select("slide", F.when(F.col("sub"), "sub").otherwise("main").alias("chain"), "dir", "width")


_RES = "r AS (SELECT p_partkey AS slide, p_size % 4 AS k, p_partkey % 7 AS lv, 40000.0::DOUBLE / (1 + p_size % 5) - 8000 AS xr, 36000.0::DOUBLE / (1 + p_size % 5) - 7200 AS yr, CASE WHEN p_size % 6 <> 0 THEN 1 + p_size % 3 END AS unit, 4096 >> (p_partkey % 3)::INT AS w, 2048 >> (p_partkey % 3)::INT AS h, p_brand AS slide_name FROM part)"


@query("tiff_mpp", f"""WITH {_RES}, m AS (SELECT *, CASE WHEN xr > 0 AND yr > 0 THEN CASE coalesce(unit, 3) WHEN 3 THEN 1e4 / xr WHEN 2 THEN 25400.0::DOUBLE / xr ELSE 0 END ELSE 0 END AS own FROM r),
o AS (SELECT *, first_value(own) OVER w AS base, first_value(w) OVER w AS base_w, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY slide_name ORDER BY w DESC, own, slide))
SELECT slide, round(CASE WHEN n = 1 THEN own ELSE base * (base_w::DOUBLE / w) END, 9)::DOUBLE AS mpp_x FROM o""")
def tiff_mpp(spark, sf_dir):
    """Own resolution of the widest directory; that one's, by widths, for all others."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS slide", "40000.0D / (1 + p_size % 5) - 8000 AS xr", "36000.0D / (1 + p_size % 5) - 7200 AS yr", "CASE WHEN p_size % 6 <> 0 THEN 1 + p_size % 3 END AS unit", "shiftright(4096, cast(p_partkey % 3 AS int)) AS w", "p_brand AS name"
    )
    rows = rows.withColumn("own", S.tiff_mpp(F.col("xr"), F.col("yr"), F.col("unit")))
    order = Window.partitionBy("name").orderBy(F.desc("w"), "own", "slide")
    rows = rows.withColumns({"base": F.first("own").over(order), "base_w": F.first("w").over(order), "n": F.row_number().over(order)})
    return rows.select("slide", F.round(F.when(F.col("n") == 1, F.col("own")).otherwise(F.col("base") * (F.col("base_w") / F.col("w"))), 9).alias("mpp_x"))


@query("tiff_mpp_fallback", "SELECT p_partkey AS slide, round(coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size / 100.0::DOUBLE END, CASE WHEN p_size % 2 = 0 THEN 0.5 * 0.001 * 1000 END, 0), 9)::DOUBLE AS mpp FROM part")
def tiff_mpp_fallback(spark, sf_dir):
    """The base level's own resolution if it has one, else that of its OME-XML, else 0."""
    own = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 100.0).otherwise(0.0)
    xml = F.when(F.col("p_size") % 2 == 0, '<OME><Pixels SizeX="7" PhysicalSizeX="0.0005" PhysicalSizeXUnit="mm"/></OME>').otherwise("<OME/>")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide"), F.round(F.coalesce(F.when(own > 0, own), S.physical_size(xml).x, F.lit(0.0)), 9).alias("mpp"))


@query("desc_mpp", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_size / 200.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 0.25 END AS mpp FROM part WHERE p_size > 0")
def desc_mpp(spark, sf_dir):
    size = F.col("p_size")
    value = (size / 200.0).cast("string")
    text = F.when(size % 4 == 0, F.concat(F.lit("lib v1|AppMag = 40| MPP = "), value, F.lit(" |x"))).when(size % 4 == 1, "lib v1|AppMag = 40\nMPP = 0.5").when(size % 4 == 2, "lib|MPP = none|MPP = -1").otherwise("lib|MPP = 0|MPP = 0.25|MPP = 9")
    return table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), S.description_mpp(text).alias("mpp"))


_UNITS = [*UNIT_UM, "furlong", ""]


@query("unit_to_um", "SELECT p_partkey AS id, CASE ([" + ", ".join(f"'{u}'" for u in _UNITS) + f"])[p_partkey % {len(_UNITS)} + 1] " + " ".join(f"WHEN '{u}' THEN {v}" for u, v in UNIT_UM.items()) + " END::DOUBLE AS um FROM part")
def unit_to_um(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.unit_um(unit).alias("um"))


@query("ome_physical_size", """SELECT id, round(CASE WHEN x > 0 AND coalesce(y, x) > 0 THEN x END, 9) AS x, round(CASE WHEN x > 0 AND coalesce(y, x) > 0 THEN coalesce(y, x) END, 9) AS y FROM (
SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN (p_size - 3) * 0.25 * CASE WHEN p_size % 2 = 0 THEN 0.001 ELSE 1.0 END END::DOUBLE AS x, CASE WHEN p_size % 3 = 0 THEN p_size * 0.5 END::DOUBLE AS y FROM part)""")
def ome_physical_size(spark, sf_dir):
    size = F.col("p_size")
    x = F.when(size % 7 != 0, F.concat(F.lit(' PhysicalSizeX="'), ((size - 3) * 0.25).cast("string"), F.lit('"'))).otherwise("")
    unit = F.when(size % 2 == 0, ' PhysicalSizeXUnit="nm"').otherwise("")
    y = F.when(size % 3 == 0, F.concat(F.lit(' PhysicalSizeY="'), (size * 0.5).cast("string"), F.lit('"'))).otherwise("")
    xml = F.concat(F.lit('<Pixels SizeX="1"'), x, unit, y, F.lit("/>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.physical_size(xml).alias("s")).select("id", F.round("s.x", 9).alias("x"), F.round("s.y", 9).alias("y"))


# decisions

_MPP = "(p_size - 2) / 40.0::DOUBLE"


@query("scale_decision", f"""WITH b AS (SELECT p_partkey AS id, CASE WHEN {_MPP} > 0 THEN {_MPP} END AS m FROM part), f AS (SELECT *, CASE WHEN m < 0.2 THEN 4 WHEN m < 0.3 THEN 2 WHEN m < 0.7 THEN 1 END AS factor, 0.8 > m AND abs(0.8 - m) / m >= 0.1 AS ok FROM b)
SELECT id, '20x' AS kind, CASE WHEN factor > 1 THEN m * factor END AS target, CASE factor WHEN 4 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS shift, CASE WHEN factor IS NULL THEN 'SKIP' WHEN factor = 1 THEN 'PASSTHROUGH' ELSE 'RESAMPLE' END AS status FROM f
UNION ALL SELECT id, 'half', coalesce(m, 1) * 2, 1, 'RESAMPLE' FROM f UNION ALL SELECT id, 'quarter', coalesce(m, 1) * 4, 2, 'RESAMPLE' FROM f
UNION ALL SELECT id, 'mpp', CASE WHEN ok THEN 0.8 END, 0, CASE WHEN ok THEN 'RESAMPLE' ELSE 'PASSTHROUGH' END FROM f UNION ALL SELECT id, 'none', NULL, 0, 'PASSTHROUGH' FROM f""")
def scale_decision(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 2) / 40.0).alias("m"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), P.scale_decision(F.col("m"), k, 0.8).alias("d")) for k in ("20x", "half", "quarter", "mpp", "none")))
    return part.select("id", F.explode(kinds).alias("k")).select("id", "k.kind", "k.d.target", "k.d.shift", "k.d.status")


@query("route_action", f"""WITH b AS (SELECT p_partkey AS id, {_MPP} AS m, p_size % 3 <> 0 AS icc FROM part), f AS (SELECT *, CASE WHEN m <= 0 THEN NULL WHEN m < 0.2 THEN 4 WHEN m < 0.3 THEN 2 WHEN m < 0.7 THEN 1 END AS factor FROM b)
SELECT id, '20x' AS kind, false AS bake, CASE WHEN factor IS NULL THEN 'skip' WHEN factor = 1 THEN 'copy' ELSE 'resample' END AS action FROM f
UNION ALL SELECT id, '20x', true, CASE WHEN NOT icc THEN 'copy' WHEN factor IS NULL THEN 'skip' WHEN factor = 1 THEN 'bake' ELSE 'resample' END FROM f
UNION ALL SELECT id, 'mpp', false, CASE WHEN m <= 0 THEN 'error' WHEN 0.5 <= m THEN 'skip' ELSE 'resample' END FROM f
UNION ALL SELECT id, 'mpp', true, CASE WHEN NOT icc THEN 'copy' WHEN m <= 0 THEN 'error' WHEN 0.5 <= m THEN 'bake' ELSE 'resample' END FROM f
UNION ALL SELECT id, 'none', true, CASE WHEN NOT icc THEN 'copy' ELSE 'bake' END FROM f UNION ALL SELECT id, 'half', false, 'resample' FROM f""")
def route_action(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 2) / 40.0).alias("m"), (F.col("p_size") % 3 != 0).alias("icc"))
    cases = [("20x", False), ("20x", True), ("mpp", False), ("mpp", True), ("none", True), ("half", False)]
    routes = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bake"), P.route_action(F.col("m"), F.col("icc"), k, b, 0.5).alias("action")) for k, b in cases))
    return part.select("id", F.explode(routes).alias("r")).select("id", "r.*")


@query("jp2k_level_skip", f"""WITH {Q.INFO_SQL}, t AS (SELECT *, max(CASE WHEN coalesce(mpp, 1e308) < 0.9 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY group_no) AS past, first_value(transfer_syntax) OVER (PARTITION BY series ORDER BY group_no) AS ts FROM info),
c AS (SELECT series, any_value(ts) AS ts, count(*) FILTER (WHERE past = 0) AS skip, arg_min(mpp, group_no) FILTER (WHERE past = 1) AS next FROM t GROUP BY series)
SELECT series, CASE WHEN right(ts, 2) IN ('90', '91', '92', '93') AND skip > 0 AND abs(next - 1.0) / 1.0 < 0.1 THEN skip END::INT AS skip FROM c""")
def jp2k_level_skip(spark, sf_dir):
    return P.jp2k_skip(Q.levels(spark, sf_dir), 1.0)


@query("alignment_filter", f"WITH {Q.INFO_SQL} SELECT series, group_no FROM info LEFT JOIN (VALUES {Q.syntax_values_sql()}) d(uid, name, tag) ON uid = transfer_syntax WHERE coalesce(tag, 34712) <> 7 OR tile % 16 = 0")
def alignment_filter(spark, sf_dir):
    tag = Q.compression_tag(F.col("transfer_syntax"))
    return Q.levels(spark, sf_dir).where((tag != 7) | (F.col("tile") % 16 == 0)).select("series", "group_no")


@query("min_side_prune", f"WITH {Q.INFO_SQL} SELECT series, group_no FROM info WHERE greatest(px_columns, px_rows) >= 512")
def min_side_prune(spark, sf_dir):
    return Q.levels(spark, sf_dir).where(F.greatest("px_columns", "px_rows") >= P.MIN_SIDE).select("series", "group_no")


@query("output_names", f"""WITH {Q.INFO_SQL}, b AS (SELECT series, any_value(transfer_syntax) AS ts FROM info GROUP BY series), f AS (SELECT *, right(ts, 2) IN ('90', '91', '92', '93') AS jp2k, series % 3 = 0 AS scaled, CASE WHEN series % 6 = 0 THEN 1 END AS skip FROM b)
SELECT series, series || '.ome.tiff' AS plain, series || CASE WHEN skip IS NOT NULL OR (NOT scaled AND jp2k) THEN '.svs' ELSE '.tiff' END AS openslide FROM f""")
def output_names(spark, sf_dir):
    base = Q.levels(spark, sf_dir).groupBy("series").agg(F.first("transfer_syntax").alias("ts"))
    stem, jp2k, scaled = F.col("series").cast("string"), F.col("ts").isin(P.JPEG2000), F.col("series") % 3 == 0
    skip = F.when(F.col("series") % 6 == 0, 1)
    return base.select("series", P.output_name(stem, scaled, jp2k, F.lit(None), False).alias("plain"), P.output_name(stem, scaled, jp2k, skip, True).alias("openslide"))


@query("phi_safe_projection", f"WITH {Q.INFO_SQL} SELECT px_columns, px_rows, tile, mpp, transfer_syntax, n_tiles, count(*) AS n_levels FROM info GROUP BY ALL")
def phi_safe_projection(spark, sf_dir):
    return K.phi_safe(Q.levels(spark, sf_dir)).groupBy(*K.PHI_SAFE).agg(F.count("*").alias("n_levels"))


@query("skip_existing", "WITH c AS (SELECT o_orderkey AS slide, 'out/' || o_orderkey AS stem FROM orders), e AS (SELECT DISTINCT 'out/' || l_orderkey || (['.tiff', '.ome.tiff', '.svs', '.png'])[l_linenumber % 4 + 1] AS path FROM lineitem WHERE l_linenumber = l_quantity % 7 + 1) SELECT slide FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path IN (c.stem || '.tiff', c.stem || '.ome.tiff', c.stem || '.svs'))")
def skip_existing(spark, sf_dir):
    slides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"), F.concat(F.lit("out/"), F.col("o_orderkey").cast("string")).alias("stem"))
    ext = F.element_at(F.array(*map(F.lit, [".tiff", ".ome.tiff", ".svs", ".png"])), F.col("l_linenumber") % 4 + 1)
    there = table(spark, sf_dir, "lineitem").where("l_linenumber = l_quantity % 7 + 1").select(F.concat(F.lit("out/"), F.col("l_orderkey").cast("string"), ext).alias("path"))
    return K.without_output(slides, there).select("slide")


_TAGS = f"""WITH {Q.INFO_SQL}, b AS (SELECT i.*, coalesce(tag, 34712) AS tag, 1 + series % 2 * 2 AS spp, CASE WHEN series % 4 <> 0 THEN mpp ELSE 0 END AS m FROM info i LEFT JOIN (VALUES {Q.syntax_values_sql()}) d(uid, name, tag) ON uid = transfer_syntax)"""


@query("ifd_tags", _TAGS + "SELECT series, group_no, px_columns AS width, px_rows AS height, ((tile + 15) // 16) * 16 AS tile_w, ((tile + 15) // 16) * 16 AS tile_h, tag::INT AS compression, spp::INT AS samples, 8 AS bits, CASE WHEN m > 0 THEN 3 END AS resolution_unit, CASE WHEN m > 0 THEN 1e4 / m END AS x_resolution FROM b")
def ifd_tags(spark, sf_dir):
    rows = Q.levels(spark, sf_dir).withColumns({"spp": (F.col("series") % 2 * 2 + 1).cast("int"), "m": F.when(F.col("series") % 4 != 0, F.col("mpp")).otherwise(0.0)})
    return rows.select("series", "group_no", K.ifd_tags(F.col("px_columns"), F.col("px_rows"), F.col("tile"), Q.compression_tag(F.col("transfer_syntax")), F.col("spp"), F.col("m")).alias("t")).select("series", "group_no", "t.*")


_PHOTOS = ["YBR_ICT", "YBR_FULL_422", "RGB", "MONOCHROME2", ""]


@query("svs_tags", "WITH r AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS jp2k, ([" + ", ".join(f"'{p}'" for p in _PHOTOS) + """])[c_custkey % 5 + 1] AS photo, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey / 20.0::DOUBLE END AS mpp, CASE WHEN c_nationkey % 5 = 0 THEN 40.0 END AS power FROM customer),
c AS (SELECT *, CASE WHEN photo IN ('YBR_ICT', 'RGB') THEN 'RGB' WHEN photo = 'MONOCHROME2' THEN 'Grayscale' ELSE 'YCbCr' END AS cs FROM r)
SELECT id, CASE WHEN NOT jp2k THEN 7 WHEN photo IN ('YBR_ICT', 'YBR_FULL_422') THEN 33003 ELSE 33005 END AS compression,
  CASE WHEN jp2k AND photo IN ('YBR_ICT', 'YBR_FULL_422') THEN 6 WHEN cs = 'Grayscale' THEN 1 WHEN jp2k THEN 2 WHEN cs = 'YCbCr' THEN 6 ELSE 2 END AS photometric,
  coalesce(power, round(0.25 / coalesce(mpp, 0.25) * 40))::DOUBLE AS app_mag FROM c WHERE mpp IS NULL OR mpp > 0""")
def svs_tags(spark, sf_dir):
    photo = F.element_at(F.array(*map(F.lit, _PHOTOS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("jp2k"), photo.alias("photo"), F.expr("CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey / 20.0D END").alias("mpp"), F.expr("CASE WHEN c_nationkey % 5 = 0 THEN 40.0D END").alias("power")
    )
    rows = rows.where("mpp IS NULL OR mpp > 0").withColumn("t", K.svs_tags(F.col("jp2k"), F.col("photo"), F.lit(None).cast("int"), F.lit(3)))
    return rows.select("id", "t.*", S.app_mag(F.col("power"), F.col("mpp")).cast("double").alias("app_mag"))


_SINK_PLAN = Q.plan_sql("base_mpp * 2", "1")


@query("sink_plan_ome", f"WITH {_SINK_PLAN}, numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY level_no) - 1 AS k FROM plan) SELECT series, level_no, CASE WHEN k = 0 THEN 0 END AS ifd, CASE WHEN k > 0 THEN k - 1 END AS sub_ifd, CASE WHEN k = 0 THEN 0 ELSE 1 END AS subfile_type, out_w, out_h, out_tile FROM numbered")
def sink_plan_ome(spark, sf_dir):
    return K.directory_plan(Q.planned(spark, sf_dir, "half"), "ome").select("series", "level_no", "ifd", "sub_ifd", "subfile_type", "out_w", "out_h", "out_tile")


@query("sink_plan_flat", f"WITH {_SINK_PLAN} SELECT series, level_no, row_number() OVER (PARTITION BY series ORDER BY level_no) - 1 AS ifd, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY level_no) = 1 THEN 0 ELSE 1 END AS subfile_type, out_w, out_h, out_tile FROM plan")
def sink_plan_flat(spark, sf_dir):
    return K.directory_plan(Q.planned(spark, sf_dir, "half"), "flat").select("series", "level_no", "ifd", "subfile_type", "out_w", "out_h", "out_tile")


@query("sink_plan_svs", f"""WITH {_SINK_PLAN}, roles AS (SELECT DISTINCT series, unnest(['THUMBNAIL', 'LABEL', 'MACRO']) AS role FROM plan),
e AS (SELECT series, CASE WHEN level_no = min(level_no) OVER (PARTITION BY series) THEN 'BASE' ELSE 'LEVEL' END AS role, level_no FROM plan UNION ALL SELECT series, role, NULL FROM roles)
SELECT series, role, level_no, row_number() OVER (PARTITION BY series ORDER BY CASE role WHEN 'BASE' THEN 0 WHEN 'THUMBNAIL' THEN 1 WHEN 'LEVEL' THEN 2 WHEN 'LABEL' THEN 3 ELSE 4 END, level_no) - 1 AS ifd, CASE role WHEN 'LABEL' THEN 1 WHEN 'MACRO' THEN 9 ELSE 0 END AS subfile_type FROM e""")
def sink_plan_svs(spark, sf_dir):
    return K.svs_plan(Q.planned(spark, sf_dir, "half")).select("series", "role", "level_no", "ifd", "subfile_type")
