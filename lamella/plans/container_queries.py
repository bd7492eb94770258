"""Queries of slides of several files, of what can be copied, and of what is shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.operators import containers as C
from lamella.plans.registry import query, table

_INDEX = "concat('in/d', s_suppkey % 3, '/s', s_suppkey, '.{ext}')"
_STREAM = "concat('in/d', (p_partkey % 120 + 1) % 3, '/_s', p_partkey % 120 + 1, '_/stack', p_size % 3, '/', CASE WHEN p_size % 7 = 0 THEN 'thumb' ELSE 'frame_t' END, p_partkey, CASE WHEN p_size % 10 = 0 THEN '.txt' ELSE '.ets' END)"
_PART = "concat('in/d', (p_partkey % 120 + 1) % 3, '/s', p_partkey % 120 + 1, CASE WHEN p_size % 5 = 0 THEN '/more' ELSE '' END, '/Data', p_partkey, '.dat')"
_VSI_SQL = f"i AS (SELECT {_INDEX.format(ext='vsi')} AS index, s_suppkey * 10 AS own, 'in/d' || (s_suppkey % 3) || '/_s' || s_suppkey || '_/' AS folder FROM supplier), f AS (SELECT {_STREAM} AS path, p_size * 1000 AS length FROM part), s AS (SELECT index, path, length FROM i JOIN f ON starts_with(path, folder) AND regexp_matches(path, '/frame[^/]*\\.ets$'))"


def _indexes(spark, sf_dir, ext):
    return table(spark, sf_dir, "supplier").selectExpr(f"{_INDEX.format(ext=ext)} AS path", "s_suppkey * 10 AS length")


def _files(spark, sf_dir, path):
    return table(spark, sf_dir, "part").selectExpr(f"{path} AS path", "cast(p_size * 1000 AS bigint) AS length")


@query("stream_files", f"WITH {_VSI_SQL} SELECT index, path, length, row_number() OVER (PARTITION BY index ORDER BY string_split(path, '/')) AS n FROM s")
def stream_files(spark, sf_dir):
    return C.stream_files(_indexes(spark, sf_dir, "vsi"), _files(spark, sf_dir, _STREAM))


@query("stream_bytes", f"WITH {_VSI_SQL} SELECT index AS path, (any_value(own) + coalesce(sum(length), 0))::BIGINT AS in_bytes FROM i LEFT JOIN s USING (index) GROUP BY index")
def stream_bytes(spark, sf_dir):
    return C.stream_bytes(_indexes(spark, sf_dir, "vsi"), _files(spark, sf_dir, _STREAM))


@query("folder_bytes", f"WITH i AS (SELECT {_INDEX.format(ext='mrxs')} AS path, s_suppkey * 10 AS own, 'in/d' || (s_suppkey % 3) || '/s' || s_suppkey AS folder FROM supplier), f AS (SELECT {_PART} AS file, p_size * 1000 AS length FROM part) SELECT path, (any_value(own) + coalesce(sum(length), 0))::BIGINT AS in_bytes FROM i LEFT JOIN f ON regexp_extract(file, '^(.*)/[^/]*$', 1) = folder GROUP BY path")
def folder_bytes(spark, sf_dir):
    return C.folder_bytes(_indexes(spark, sf_dir, "mrxs"), _files(spark, sf_dir, _PART))


@query("tiled_levels", "SELECT p_partkey AS level, p_size * 16 AS tile_w FROM part WHERE p_size % 4 <> 0 AND p_size % 9 <> 0")
def tiled_levels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS level", "CASE WHEN p_size % 4 <> 0 THEN p_size * 16 END AS tile_w", "CASE WHEN p_size % 9 <> 0 THEN p_size END AS tile_h")
    return C.tiled_only(rows).select("level", "tile_w")


@query("filled_fragments", "SELECT event_id AS ordinal, user_id AS file, length(event_type) AS nbytes FROM events WHERE event_id % 5 <> 0")
def filled_fragments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("file"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise("").cast("binary").alias("data"))
    return C.filled(rows).select("ordinal", "file", F.length("data").cast("long").alias("nbytes"))


_PROFILES = "p_partkey % 250 AS slide, p_partkey AS group_no, CASE WHEN p_size % 6 <> 0 THEN p_size * 8 END AS tile_w, CASE WHEN p_size % 6 <> 0 THEN p_size * 16 END AS tile_h, p_size % 2 = 1 AS jpeg, CASE WHEN p_size % 5 <> 0 THEN p_name END AS profile"


@query("first_profile", f"SELECT slide, arg_min(profile, group_no) FILTER (WHERE tile_w IS NOT NULL AND (NOT jpeg OR (tile_w % 16 = 0 AND tile_h % 16 = 0)) AND profile IS NOT NULL) AS profile FROM (SELECT {_PROFILES} FROM part) GROUP BY slide")
def first_profile(spark, sf_dir):
    return C.first_profile(table(spark, sf_dir, "part").selectExpr(*_PROFILES.split(", ")), ["slide"])


_SCALES = ["20x", "half", "quarter", "none", "mpp"]
_FACTOR = "CASE WHEN mpp <= 0 THEN NULL WHEN mpp < 0.2 THEN {} WHEN mpp < 0.3 THEN {} WHEN mpp < 0.7 THEN {} END"


@query("scale_starts", f"""WITH p AS (SELECT p_partkey AS slide, (p_size - 2) / 40.0::DOUBLE AS mpp, unnest({_SCALES}) AS scale FROM part)
SELECT slide, scale, CASE scale WHEN 'quarter' THEN 2 WHEN 'half' THEN 1 WHEN '20x' THEN {_FACTOR.format(2, 1, 0)} ELSE 0 END AS start_res,
  CASE scale WHEN 'quarter' THEN 4.0 WHEN 'half' THEN 2.0 WHEN '20x' THEN {_FACTOR.format(4, 2, 1)} WHEN 'mpp' THEN CASE WHEN mpp > 0 AND 0.5 > mpp THEN 0.5::DOUBLE / mpp ELSE 1 END ELSE 1 END::DOUBLE AS downsample FROM p""")
def scale_starts(spark, sf_dir):
    """Where a streamed slide starts, and how far a placed one is scaled, for each kind of request."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS slide", "(p_size - 2) / 40.0D AS mpp").withColumn("scale", F.explode(F.array(*map(F.lit, _SCALES))))
    target = F.when(F.col("scale") == "mpp", F.lit(0.5))
    return rows.select("slide", "scale", C.start_resolution(F.col("scale"), F.col("mpp")).alias("start_res"), C.base_downsample(F.col("scale"), target, F.col("mpp")).alias("downsample"))


@query("shown_names", "WITH n AS (SELECT page_id, url, greatest(51 - length('(' || page_id || ')'), 0) AS room FROM (SELECT page_id, url || '/' || repeat('é', (page_id % 60)::INT) AS url FROM pages)) SELECT page_id AS id, '(' || page_id || ') ' || CASE WHEN length(url) > room THEN '…' || right(url, room - 1) ELSE url END AS shown FROM n")
def shown_names(spark, sf_dir):
    name = F.expr("concat(url, '/', repeat('é', cast(page_id % 60 AS int)))")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), S.shown_name(F.col("page_id"), name).alias("shown"))


@query("epoch_text", "SELECT o_orderkey AS id, strftime(TIMESTAMP '1970-01-01' + to_days((o_custkey * 37 % 40000)::INT) + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def epoch_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.epoch_text(F.col("o_custkey") * 37 % 40000, F.col("o_orderkey") % 86400).alias("stamp"))
