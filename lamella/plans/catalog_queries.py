"""Queries of the catalogue: discovery, filters, series, resolutions, metadata, and the flagship summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.functions.dims import PHOTOMETRIC, WSI_CLASS, WSI_MODALITY, compression_name, compression_tag, syntax_values_sql
from lamella.operators import catalog as C
from lamella.operators import planner as P
from lamella.operators import tiles as T
from lamella.plans import fixtures as X
from lamella.plans.registry import query, table

TIE = X.TIE
_TIE_SQL = ", ".join(TIE)
_EXTENSIONS = ["dcm", "DCM", "tiff", "svs", "tif", "vsi", "mrxs", "txt"]


def paths(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("in/d"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("page_id") % 8 + 1).cast("int"))).alias("path")
    )


_PATHS_SQL = "paths AS (SELECT 'in/d' || (page_id % 9) || '/p' || page_id || '.' || (['" + "', '".join(_EXTENSIONS) + "'])[page_id % 8 + 1] AS path FROM pages)"


@query("discover_by_extension", f"""WITH {_PATHS_SQL}, b AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
  CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'dcm' THEN 'dicom' WHEN 'tiff' THEN 'tiff' WHEN 'svs' THEN 'tiff' WHEN 'vsi' THEN 'vsi' WHEN 'mrxs' THEN 'mirax' END AS bucket FROM paths)
SELECT bucket, dir, path FROM b WHERE bucket IS NOT NULL""")
def discover_by_extension(spark, sf_dir):
    return C.discover(paths(spark, sf_dir)).select("bucket", "dir", "path")


@query("scan_slide_files", f"""WITH {X.D1_SQL} SELECT path AS file_path, coalesce(sop_class, '') AS sop_class_uid, series::VARCHAR AS series_instance_uid, coalesce(modality, '') AS modality, transfer_syntax AS transfer_syntax_uid,
  CASE WHEN l_quantity % 7 <> 0 THEN n_frames END AS n_frames, px_columns, px_rows, image_type, tile AS tile_w, tile AS tile_h, mpp AS mpp_x, mpp AS mpp_y,
  CASE WHEN l_quantity % 3 = 0 THEN l_quantity END AS objective_power, 3 AS spp FROM d1""")
def scan_slide_files(spark, sf_dir):
    """Attributes come as text, are trimmed, and are null where they are no number."""
    raw = X.slide_files(spark, sf_dir)
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
    raw = raw.withColumns({c: text(c) for c in ("px_columns", "px_rows", "tile", "mpp")}).withColumns(
        {"n_frames": F.when(F.col("l_quantity") % 7 != 0, text("n_frames")).otherwise("many"), "power": F.when(F.col("l_quantity") % 3 == 0, text("l_quantity"))}
    )
    number = lambda c, t="long": F.trim(F.col(c)).try_cast(t)
    return raw.select(
        F.col("path").alias("file_path"),
        F.coalesce("sop_class", F.lit("")).alias("sop_class_uid"),
        F.col("series").cast("string").alias("series_instance_uid"),
        F.coalesce("modality", F.lit("")).alias("modality"),
        F.col("transfer_syntax").alias("transfer_syntax_uid"),
        number("n_frames").alias("n_frames"),
        number("px_columns").alias("px_columns"),
        number("px_rows").alias("px_rows"),
        "image_type",
        number("tile").alias("tile_w"),
        number("tile").alias("tile_h"),
        number("mpp", "double").alias("mpp_x"),
        number("mpp", "double").alias("mpp_y"),
        number("power", "double").alias("objective_power"),
        F.lit(3).alias("spp"),
    )


@query("dir_groups", f"""WITH {X.D1_SQL} SELECT directory AS dir, count(*) AS n_files, min(path) AS first_path, md5(string_agg(path, ',' ORDER BY path)) AS files_md5,
  row_number() OVER (ORDER BY min(path)) AS dir_no FROM d1 GROUP BY directory""")
def dir_groups(spark, sf_dir):
    files = X.slide_files(spark, sf_dir).groupBy("directory").agg(F.sort_array(F.collect_list("path")).alias("files"))
    files = files.select(
        F.col("directory").alias("dir"),
        F.size("files").cast("long").alias("n_files"),
        F.col("files")[0].alias("first_path"),
        F.md5(F.array_join("files", ",").cast("binary")).alias("files_md5"),
        F.lit(0).alias("all"),
    )
    return T.numbered(files, "all", "first_path", "dir_no").drop("all")


@query("series_groups", f"WITH {X.D1_SQL} SELECT directory AS dir, series, count(*) AS n_files, min(path) AS first_path FROM d1 GROUP BY ALL")
def series_groups(spark, sf_dir):
    return X.slide_files(spark, sf_dir).groupBy(F.col("directory").alias("dir"), "series").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))


@query("wsi_filter", f"WITH {X.D1_SQL} SELECT path, series FROM d1 WHERE sop_class = '{WSI_CLASS}' AND modality = '{WSI_MODALITY}'")
def wsi_filter(spark, sf_dir):
    return C.wsi_only(X.slide_files(spark, sf_dir)).select("path", "series")


VOLUME_SQL = f"{X.D1_SQL}, vol AS (SELECT * FROM d1 WHERE contains(image_type, 'VOLUME') AND px_columns >= tile AND px_rows >= tile)"


@query("volume_levels", f"WITH {VOLUME_SQL} SELECT path, series, row_number() OVER (PARTITION BY series ORDER BY px_columns DESC, {_TIE_SQL}) AS ord FROM vol")
def volume_levels(spark, sf_dir):
    order = Window.partitionBy("series").orderBy(*C.series_order(TIE))
    return C.volume_levels(X.slide_files(spark, sf_dir)).select("path", "series", F.row_number().over(order).cast("long").alias("ord"))


@query("role_pick", f"""WITH {X.D1_SQL} SELECT series, first(path ORDER BY {_TIE_SQL}) FILTER (WHERE contains(image_type, 'THUMBNAIL')) AS thumbnail,
  first(path ORDER BY {_TIE_SQL}) FILTER (WHERE contains(image_type, 'OVERVIEW')) AS overview, first(path ORDER BY {_TIE_SQL}) FILTER (WHERE contains(image_type, 'LABEL')) AS label FROM d1 GROUP BY series""")
def role_pick(spark, sf_dir):
    return C.role_pick(X.slide_files(spark, sf_dir), TIE)


GROUPS_SQL = f"""{VOLUME_SQL}, o AS (SELECT *, row_number() OVER w AS ord,
    CASE WHEN lag(px_columns) OVER w IS NOT DISTINCT FROM px_columns AND lag(px_rows) OVER w IS NOT DISTINCT FROM px_rows THEN 0 ELSE 1 END AS new
  FROM vol WINDOW w AS (PARTITION BY series ORDER BY px_columns DESC, {_TIE_SQL})),
grp AS (SELECT *, (sum(new) OVER (PARTITION BY series ORDER BY ord))::BIGINT AS group_no FROM o)"""


def grouped(spark, sf_dir) -> DataFrame:
    return C.resolution_groups(C.volume_levels(X.slide_files(spark, sf_dir)), TIE)


@query("resolution_groups", f"WITH {GROUPS_SQL} SELECT series, path, ord, group_no FROM grp")
def resolution_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("series", "path", F.col("ord").cast("long").alias("ord"), "group_no")


INFO_SQL = f"""{GROUPS_SQL}, info AS (SELECT series, group_no, arg_min(px_columns, ord) AS px_columns, arg_min(px_rows, ord) AS px_rows, arg_min(tile, ord) AS tile, arg_min(mpp, ord) AS mpp,
  arg_min(transfer_syntax, ord) AS transfer_syntax, sum(coalesce(n_frames, 0))::BIGINT AS n_tiles FROM grp GROUP BY series, group_no)"""


def levels(spark, sf_dir) -> DataFrame:
    return C.level_info(grouped(spark, sf_dir))


@query("level_info", f"WITH {INFO_SQL} SELECT * FROM info")
def level_info(spark, sf_dir):
    return levels(spark, sf_dir)


_PLAN_TEXT = """, slides AS (SELECT i.*, first_value(mpp) OVER (PARTITION BY series ORDER BY group_no) AS base_mpp FROM info i),
dec AS (SELECT *, {target} AS target, {shift} AS shift FROM slides),
tgt AS (SELECT *, target * (mpp / base_mpp) AS level_target FROM dec WHERE target IS NOT NULL),
near AS (SELECT t.series, t.group_no AS level_no, t.shift, t.level_target, s.group_no AS src_no, s.px_columns, s.px_rows, s.tile, s.mpp, s.transfer_syntax, s.n_tiles,
    row_number() OVER (PARTITION BY t.series, t.group_no ORDER BY abs(s.mpp - t.level_target), s.group_no) AS rn
  FROM tgt t JOIN info s ON s.series = t.series),
pick AS (SELECT n.*, coalesce(d.tag, 34712) AS tag FROM near n LEFT JOIN (VALUES """ + syntax_values_sql() + """) d(uid, name, tag) ON d.uid = n.transfer_syntax WHERE rn = 1),
pas AS (SELECT *, (abs(mpp - level_target) / level_target < 0.1) AND tag = 7 AND tile % 16 = 0 AND NOT {bake} AS passthrough,
    CASE WHEN shift > 0 AND {exact} THEN greatest((tile + (1 << shift) - 1) // (1 << shift), 1) ELSE {half} END AS half FROM pick),
outp AS (SELECT series, level_no, src_no, passthrough,
    CASE WHEN passthrough THEN px_columns ELSE round(px_columns * (half::DOUBLE / tile))::BIGINT END AS out_w,
    CASE WHEN passthrough THEN px_rows ELSE round(px_rows * (half::DOUBLE / tile))::BIGINT END AS out_h,
    CASE WHEN passthrough THEN tile ELSE half * 2 END AS out_tile,
    CASE WHEN passthrough THEN mpp ELSE mpp * tile / half END AS actual_mpp, level_target, n_tiles FROM pas),
plan AS (SELECT series, level_no, src_no, passthrough, out_w, out_h, out_tile, round(actual_mpp, 6) AS actual_mpp, round(level_target, 6) AS level_target,
    CASE WHEN passthrough THEN n_tiles ELSE ((out_w + out_tile - 1) // out_tile) * ((out_h + out_tile - 1) // out_tile) END AS out_tiles,
    actual_mpp > level_target * 1.5 AS overscaled FROM outp WHERE greatest(out_w, out_h) >= 512)"""
_EXACT = "right(transfer_syntax, 2) IN ('50', '51', '90', '91', '92', '93')"
_FACTOR = "CASE WHEN base_mpp <= 0 THEN NULL WHEN base_mpp < 0.2 THEN 4 WHEN base_mpp < 0.3 THEN 2 WHEN base_mpp < 0.7 THEN 1 END"
_HALF_DICOM = "greatest((greatest(round(tile * mpp / level_target * 2 / 16), 1) * 16)::BIGINT // 2, 1)"
_HALF_TIFF = "(greatest(round(tile * mpp / level_target / 16), 1) * 16)::BIGINT"


def plan_sql(target: str, shift: str, bake: str = "false", tiff: bool = False) -> str:
    exact = "tag IN (7, 33003, 33005, 34712)" if tiff else _EXACT
    return INFO_SQL + _PLAN_TEXT.format(target=target, shift=shift, bake=bake, exact=exact, half=_HALF_TIFF if tiff else _HALF_DICOM)


_T20, _S20 = f"CASE WHEN {_FACTOR} > 1 THEN base_mpp * {_FACTOR} END", f"CASE {_FACTOR} WHEN 4 THEN 2 WHEN 2 THEN 1 ELSE 0 END"


def planned(spark, sf_dir, kind: str, number: float | None = None, **how) -> DataFrame:
    info = levels(spark, sf_dir)
    first = Window.partitionBy("series").orderBy("group_no")
    info = info.withColumn("decision", P.scale_decision(F.first("mpp").over(first), kind, number))
    plan = P.plan_levels(info, F.col("decision.target"), F.col("decision.shift"), **how)
    return plan.withColumns({"actual_mpp": F.round("actual_mpp", 6), "level_target": F.round("level_target", 6)})


@query("plan_levels_dicom", f"WITH {plan_sql('CASE WHEN 0.8 > base_mpp AND abs(0.8 - base_mpp) / base_mpp >= 0.1 THEN 0.8 END', '0')} SELECT * FROM plan")
def plan_levels_dicom(spark, sf_dir):
    return planned(spark, sf_dir, "mpp", 0.8)


@query("plan_levels_tiff", f"WITH {plan_sql('base_mpp * 2', '1', tiff=True)} SELECT * FROM plan")
def plan_levels_tiff(spark, sf_dir):
    return planned(spark, sf_dir, "half", tiff=True)


@query("plan_summary_20x", f"""WITH {plan_sql(_T20, _S20)} SELECT series, count(*) AS n_levels, count(*) FILTER (WHERE passthrough) AS n_passthrough, sum(out_tiles)::BIGINT AS n_tiles,
  max(out_w) AS out_w, max(out_h) AS out_h, min(actual_mpp) AS actual_mpp, max(CASE WHEN level_no = 1 THEN src_no END) AS base_src FROM plan GROUP BY series""")
def plan_summary_20x(spark, sf_dir):
    """For each slide at 20x: its output levels, how many are copied, and their tiles."""
    return planned(spark, sf_dir, "20x").groupBy("series").agg(
        F.count("*").alias("n_levels"),
        F.count_if("passthrough").alias("n_passthrough"),
        F.sum("out_tiles").alias("n_tiles"),
        F.max("out_w").alias("out_w"),
        F.max("out_h").alias("out_h"),
        F.min("actual_mpp").alias("actual_mpp"),
        F.max(F.when(F.col("level_no") == 1, F.col("src_no"))).alias("base_src"),
    )


@query("icc_presence", """SELECT p_partkey AS file, coalesce(nullif(CASE WHEN p_size % 3 = 1 THEN p_name WHEN p_size % 3 = 0 THEN '' END, ''), nullif(CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 < 3 THEN p_brand END, '')) AS profile FROM part""")
def icc_presence(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    optical = F.expr("CASE WHEN p_size % 3 = 1 THEN p_name WHEN p_size % 3 = 0 THEN '' END")
    top = F.expr("CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 < 3 THEN p_brand END")
    return part.select(F.col("p_partkey").alias("file"), C.icc_profile(optical, top).alias("profile"))


_MPP_RAW = "SELECT p_partkey AS file, CASE WHEN p_size % 4 <> 0 THEN p_size * 1.5 END AS vw, CASE WHEN p_size % 7 <> 0 THEN p_size * 1.25 END AS vh, 1000 + p_partkey % 5000 AS px, 900 + p_partkey % 4000 AS py, {spacing} AS spacing FROM part"


@query("mpp_derivation", "WITH r AS (" + _MPP_RAW.format(spacing="CASE p_size % 3 WHEN 1 THEN '0.0005\\0.00025' WHEN 2 THEN '0.001' END") + """), n AS (SELECT *, vw * 1000 / px AS ox, vh * 1000 / py AS oy, string_split(spacing, '\\') AS parts FROM r)
SELECT file, CASE WHEN vw IS NOT NULL AND vh IS NOT NULL THEN ox WHEN len(parts) >= 2 THEN parts[2]::DOUBLE * 1000 ELSE ox END::DOUBLE AS mpp_x, CASE WHEN vw IS NOT NULL AND vh IS NOT NULL THEN oy WHEN len(parts) >= 2 THEN parts[1]::DOUBLE * 1000 ELSE oy END::DOUBLE AS mpp_y FROM n""")
def mpp_derivation(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") * F.lit(1.5)).alias("vw"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") * F.lit(1.25)).alias("vh"),
        (F.col("p_partkey") % 5000 + 1000).alias("px"),
        (F.col("p_partkey") % 4000 + 900).alias("py"),
        F.when(F.col("p_size") % 3 == 1, "0.0005\\0.00025").when(F.col("p_size") % 3 == 2, "0.001").alias("spacing"),
    )
    x = S.dicom_mpp(F.col("vw"), F.col("vh"), F.col("px"), F.col("spacing"), 2)
    y = S.dicom_mpp(F.col("vh"), F.col("vw"), F.col("py"), F.col("spacing"), 1)
    return part.select("file", x.alias("mpp_x"), y.alias("mpp_y"))


_PHOTO = [*PHOTOMETRIC, "PALETTE COLOR", ""]


@query("color_space", "WITH r AS (SELECT c_custkey AS file, ([" + ", ".join(f"'{p}'" for p in _PHOTO) + """])[c_custkey % 9 + 1] AS photo, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey % 2 END AS app14, 1 + c_custkey % 2 * 2 AS samples FROM customer)
SELECT file, CASE WHEN photo IN ('RGB', 'YBR_ICT', 'YBR_RCT') THEN 'RGB' WHEN photo IN ('YBR_FULL', 'YBR_FULL_422') THEN 'YCbCr' WHEN photo IN ('MONOCHROME1', 'MONOCHROME2') THEN 'Grayscale'
  WHEN app14 = 0 THEN 'RGB' WHEN app14 IS NOT NULL THEN 'YCbCr' WHEN samples = 1 THEN 'Grayscale' ELSE 'YCbCr' END AS color_space FROM r""")
def color_space(spark, sf_dir):
    photo = F.element_at(F.array(*map(F.lit, _PHOTO)), (F.col("c_custkey") % 9 + 1).cast("int"))
    app14 = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey") % 2)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), C.color_space(photo, app14, F.col("c_custkey") % 2 * 2 + 1).alias("color_space"))


@query("transfer_syntax_dim", f"""WITH {X.D1_SQL} SELECT transfer_syntax, coalesce(name, 'Unknown/Uncompressed') AS compression, coalesce(tag, 34712) AS tag, count(*) AS n_files
FROM d1 LEFT JOIN (VALUES {syntax_values_sql()}) d(uid, name, tag) ON uid = transfer_syntax GROUP BY ALL""")
def transfer_syntax_dim(spark, sf_dir):
    uid = F.col("transfer_syntax")
    files = X.slide_files(spark, sf_dir).groupBy("transfer_syntax").agg(F.count("*").alias("n_files"))
    return files.select("transfer_syntax", compression_name(uid).alias("compression"), compression_tag(uid).alias("tag"), "n_files")


@query("frame_tile_index", f"""WITH {X.D2_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_TIE_SQL}) - 1 AS ordinal, bool_and(column_pos IS NOT NULL) OVER (PARTITION BY file) AS placed FROM d2)
SELECT file, ordinal, CASE WHEN placed THEN ((row_pos - 1) // 256) * 16 + (column_pos - 1) // 256 ELSE ordinal END AS tile_index FROM o""")
def frame_tile_index(spark, sf_dir):
    return C.frame_tiles(X.frames(spark, sf_dir), TIE, 256, 4096).select("file", "ordinal", "tile_index")
