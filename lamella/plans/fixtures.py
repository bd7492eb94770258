"""Slides, frames, tiles, placements and outcomes derived from the star-schema tables, by the same formulas in Spark
and in DuckDB (the *_SQL texts are common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.dims import TRANSFER_SYNTAXES, WSI_CLASS
from lamella.plans.registry import table

#: What orders the files of a series that are equally wide.
TIE = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
_UIDS = [u for u, _, _ in TRANSFER_SYNTAXES] + ["1.2.840.10008.1.2.1", ""]


def slide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", *TIE)
    return (
        rows.withColumns(
            {
                "series": F.col("l_orderkey"),
                "level": F.expr("cast((l_linenumber - 1) % 3 AS int)"),
                "base_mpp": F.expr("element_at(array(0.125D, 0.25D, 0.5D, 1.0D), cast(l_orderkey % 4 + 1 AS int))"),
                "tile": F.expr("CASE WHEN l_orderkey % 5 = 0 THEN 250L ELSE 256L END"),
                "image_type": F.expr("CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'DERIVED\\\\PRIMARY\\\\LABEL' ELSE 'ORIGINAL\\\\PRIMARY\\\\VOLUME' END"),
                "sop_class": F.expr(f"CASE WHEN l_linestatus = 'O' THEN '{WSI_CLASS}' ELSE '1.2.840.10008.5.1.4.1.1.77.1.4' END"),
                "modality": F.expr("CASE WHEN l_returnflag = 'A' THEN 'CR' ELSE 'SM' END"),
                "transfer_syntax": F.element_at(F.array(*map(F.lit, _UIDS)), (F.col("l_orderkey") % len(_UIDS) + 1).cast("int")),
                "directory": F.concat(F.lit("in/d"), (F.col("l_orderkey") % 7).cast("string")),
            }
        )
        .withColumns(
            {
                "px_columns": F.expr("shiftright(4096 + 512 * (l_orderkey % 17), 2 * level)"),
                "px_rows": F.expr("shiftright(3072 + 256 * (l_orderkey % 13), 2 * level)"),
                "mpp": F.expr("base_mpp * shiftleft(1, 2 * level)"),
            }
        )
        .withColumn("n_frames", F.expr("((px_columns + tile - 1) div tile) * ((px_rows + tile - 1) div tile)"))
        .withColumn("path", F.expr("concat(directory, '/', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '.dcm')"))
    )


D1_SQL = (
    """d1 AS (
  SELECT *, ((px_columns + tile - 1) // tile) * ((px_rows + tile - 1) // tile) AS n_frames FROM (
    SELECT *, (4096 + 512 * (l_orderkey % 17)) >> (2 * level) AS px_columns, (3072 + 256 * (l_orderkey % 13)) >> (2 * level) AS px_rows,
      base_mpp * (1 << (2 * level)) AS mpp,
      directory || '/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '.dcm' AS path
    FROM (
      SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate,
        l_orderkey AS series, ((l_linenumber - 1) % 3)::INT AS level,
        ([0.125::DOUBLE, 0.25, 0.5, 1.0])[l_orderkey % 4 + 1] AS base_mpp,
        CASE WHEN l_orderkey % 5 = 0 THEN 250::BIGINT ELSE 256::BIGINT END AS tile,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'DERIVED\\PRIMARY\\LABEL' ELSE 'ORIGINAL\\PRIMARY\\VOLUME' END AS image_type,
        CASE WHEN l_linestatus = 'O' THEN '"""
    + WSI_CLASS
    + """' ELSE '1.2.840.10008.5.1.4.1.1.77.1.4' END AS sop_class,
        CASE WHEN l_returnflag = 'A' THEN 'CR' ELSE 'SM' END AS modality,
        (["""
    + ", ".join(f"'{u}'" for u in _UIDS)
    + """])[l_orderkey % 12 + 1] AS transfer_syntax,
        'in/d' || (l_orderkey % 7) AS directory
      FROM lineitem)))"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a file, in order, with 1-based pixel positions that some lack."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", *TIE)
    return rows.select(
        F.col("l_orderkey").alias("file"),
        *TIE,
        F.when(F.col("l_quantity") != 1, F.col("l_partkey") % 16 * 256 + 1).alias("column_pos"),
        F.when(F.col("l_quantity") != 1, F.col("l_suppkey") % 16 * 256 + 1).alias("row_pos"),
    )


D2_SQL = """d2 AS (
  SELECT l_orderkey AS file, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate,
    CASE WHEN l_quantity <> 1 THEN l_partkey % 16 * 256 + 1 END AS column_pos,
    CASE WHEN l_quantity <> 1 THEN l_suppkey % 16 * 256 + 1 END AS row_pos FROM lineitem)"""


def gray_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray tiles in an 8 x 8 grid of each slide."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pixel = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 128 + 128).cast("int")))
    return rows.selectExpr("vec_id div 64 AS slide", "vec_id % 8 AS cx", "vec_id % 64 div 8 AS cy", "embedding").select(
        "slide", "cx", "cy", F.transform("embedding", pixel).alias("pixels")
    )


D3_SQL = """d3 AS (
  SELECT vec_id // 64 AS slide, vec_id % 8 AS cx, (vec_id % 64) // 8 AS cy,
    list_transform(embedding, lambda e: greatest(0, least(255, floor(e::DOUBLE * 128 + 128)::INT))) AS pixels FROM embeddings)"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping captures, in painting order."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 10 AS slide", "event_id AS seq", "cast(floor(event_id % 37 * 190 + value) AS bigint) AS x", "cast(floor(event_id % 29 * 170 + value) AS bigint) AS y", "256L AS size"
    )


D4_SQL = """d4 AS (
  SELECT user_id % 10 AS slide, event_id AS seq, floor((event_id % 37) * 190 + value)::BIGINT AS x, floor((event_id % 29) * 170 + value)::BIGINT AS y, 256::BIGINT AS size FROM events)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS slide",
        "CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'FAIL' ELSE 'SKIP' END AS status",
        "cast(floor(o_totalprice) AS bigint) AS in_bytes",
        "cast(floor(o_totalprice * 0.25) AS bigint) AS out_bytes",
        "o_orderdate AS finished",
    )


D6_SQL = """d6 AS (
  SELECT o_orderkey AS slide, CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'FAIL' ELSE 'SKIP' END AS status,
    floor(o_totalprice)::BIGINT AS in_bytes, floor(o_totalprice * 0.25)::BIGINT AS out_bytes, o_orderdate AS finished FROM orders)"""
