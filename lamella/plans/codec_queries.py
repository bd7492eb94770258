"""Queries of byte formats: byte formats on streams built from the tables, real-file sources, incremental ingest."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lamella.functions import binfmt as B
from lamella.functions import dicom as D
from lamella.functions import jpeg as J
from lamella.functions.dims import WSI_CLASS
from lamella.operators import kernels as K
from lamella.operators import tiles as T
from lamella.operators.sinks import tiff_files
from lamella.plans import fixtures as X
from lamella.plans.registry import query, table
from lamella.sources import slides
from lamella.streaming.ingest import ingest_new
from lamella.workspace import shared_dir


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@F.pandas_udf(BinaryType())
def _stream(k: pd.Series) -> pd.Series:
    """A small JPEG-like stream for each number: one in four is gray, one in four halved in height too; one in five has a
    second start mark, and one in seven ends before its scan."""

    def one(n: int) -> bytes:
        parts = b"\x01\x11\x00" if n % 4 == 0 else bytes([1, 0x22 if n % 4 == 1 else 0x21, 0, 2, 0x11, 1, 3, 0x11, 1])
        frame = b"\x08\x00\x10\x00\x10" + bytes([len(parts) // 3]) + parts
        tables = _segment(0xDB, bytes([n % 3] * 65)) + _segment(0xC4, bytes([n % 2] * 20))
        head = b"\xff\xd8" + _segment(0xE0, b"app") + b"\xff\xd8" * (n % 5 == 0) + tables + _segment(0xC0, frame)
        return head + (_segment(0xDA, b"\x01\x01\x00") + bytes([n % 250] * 8) + b"\xff\xd9" if n % 7 else b"")

    return pd.Series([one(int(n)) for n in k], dtype=object)


def streams(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile"), _stream("p_partkey").alias("data"))


_PARTS = """s AS (SELECT p_partkey AS tile, 'FFD8FFDB0043' || repeat(printf('%02X', p_partkey % 3), 65) || 'FFC40016' || repeat(printf('%02X', p_partkey % 2), 20) || 'FFD9' AS tables,
  CASE WHEN p_partkey % 4 = 0 THEN 15 ELSE 21 END + CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 17 END AS tile_bytes FROM part)"""


@query("jpeg_subsampling", "SELECT p_partkey AS tile, CASE WHEN p_partkey % 4 > 0 THEN 2 END AS h, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END AS v FROM part")
def jpeg_subsampling(spark, sf_dir):
    return streams(spark, sf_dir).select("tile", J.subsampling_udf("data").alias("s")).select("tile", "s.*")


@query("jpeg_split", f"WITH {_PARTS} SELECT tile, 97 AS tables_bytes, tile_bytes, md5(unhex(tables)) AS tables_md5 FROM s")
def jpeg_split(spark, sf_dir):
    parts = streams(spark, sf_dir).select("tile", J.split_udf("data").alias("s"))
    return parts.select("tile", F.length("s.tables").alias("tables_bytes"), F.length("s.tile").alias("tile_bytes"), F.md5("s.tables").alias("tables_md5"))


@query("jpeg_rejoin", f"WITH {_PARTS} SELECT tile, 93 + tile_bytes AS bytes, true AS same FROM s")
def jpeg_rejoin(spark, sf_dir):
    """Split, joined again, split again: the same parts."""
    parts = streams(spark, sf_dir).select("tile", J.split_udf("data").alias("s")).select("tile", "s", J.rejoin_udf("s.tables", "s.tile").alias("whole"))
    return parts.select("tile", "s", F.length("whole").alias("bytes"), J.split_udf("whole").alias("t")).select("tile", "bytes", (F.col("s") == F.col("t")).alias("same"))


def _tagged(fields: list[tuple[int, int, bytes]]) -> bytes:
    """A container of (type, tag, value) fields, each of which tells where the next one is."""
    out, at = struct.pack("<qqI", 0, 24, len(fields)) + b"\0" * 4, 24
    for kind, tag, body in fields:
        at += 16 + len(body)
        out += struct.pack("<IiIi", kind, tag, at, len(body)) + body
    return out


def _tree(n: int) -> bytes:
    """Two pyramids. The first one's name and boundary are in sibling containers; an inline field, a value of another type
    and what comes again behind the slide's properties are no values."""
    text = B.UTF16_TEXT, B.STACK_NAME, f"slide {n}\0".encode("utf-16-le")
    box = lambda w, h: (B.RECTANGLES[2], B.BOUNDARY, struct.pack("<iiii", 0, 0, w, h))
    frame = (2, B.IMAGE_FRAME, b"\1\0\0\0")
    wrong = [(B.INLINE | B.LATIN_TEXT, B.STACK_NAME, b"inline"), (3, B.BOUNDARY, struct.pack("<iiii", 0, 0, 5, 5))]
    files = B.EXTENDED | B.VOLUMES, B.EXTERNAL_FILES, _tagged([*wrong, text]) + _tagged([box(1000 + n, 900 + n)])
    nested = B.EXTENDED | B.NESTED[0], B.EXTERNAL_FILES, _tagged([box(64, 32), (B.LATIN_TEXT, B.STACK_NAME, f"label {n}".encode())])
    again = [(2, B.SLIDE, b"\0" * 4), frame, (2, B.EXTERNAL_FILES, b"\0" * 4), box(7, 7)]
    return b"\0" * 8 + _tagged([frame, files, (B.PAIR, B.SCALE, struct.pack("<dd", 0.25, 0.5)), *again, frame, nested]) + b"\0" * 8


def _dicom(n: int) -> bytes:
    """A file of 3 frames: one in 3 without places, one in 5 without a volume's size, one in 7 with a profile."""
    number = lambda tag, vr, kind, v: D.element(tag, vr, struct.pack("<" + kind, v))
    place = lambda k: D.element(D.PLANE, b"SQ", [number(D.COLUMN_POS, b"SL", "i", 1 + 256 * ((n + k) % 4)) + number(D.ROW_POS, b"SL", "i", 1 + 256 * k)])
    parts = [
        D.element(D.IMAGE_TYPE, b"CS", b"ORIGINAL\\PRIMARY\\VOLUME"),
        D.element(D.SOP_CLASS, b"UI", WSI_CLASS.encode()),
        D.element(D.MODALITY, b"CS", b"SM"),
        D.element(D.SERIES, b"UI", f"1.2.{n % 10}".encode()),
        number(D.SAMPLES, b"US", "H", 3),
        D.element(D.FRAMES, b"IS", b" 3"),
        number(D.ROWS, b"US", "H", 256),
        number(D.COLUMNS, b"US", "H", 256),
        D.element(D.SPACING, b"DS", b"0.001 \\0.0005"),
        *([number(D.VOLUME_WIDTH, b"FL", "f", 0.25 * (n % 8 + 1)), number(D.VOLUME_HEIGHT, b"FL", "f", 0.5)] if n % 5 else []),
        number(D.MATRIX_COLUMNS, b"UL", "I", 1024),
        number(D.MATRIX_ROWS, b"UL", "I", 768),
        *([D.element(D.OPTICAL_PATHS, b"SQ", [D.element(D.PROFILE, b"OB", b"profile!")])] if n % 7 == 0 else []),
        *([D.element(D.PER_FRAME, b"SQ", [place(k) for k in range(3)])] if n % 3 else []),
    ]
    return D.file("1.2.840.10008.1.2.4.50", parts, [bytes([k] * (2 * k + 2)) for k in range(3)])


def _tiles(n: int) -> bytes:
    chunks = [([k % 3, k // 3, 0, k % 2], 1000 * k, 50 + k) for k in range(n % 5 + 1)]
    head = bytearray(64)
    head[0:3] = b"SIS"
    struct.pack_into("<i", head, 12, 4)
    struct.pack_into("<q", head, 16, 64)
    struct.pack_into("<qi", head, 32, 64 + 160, len(chunks))
    extra = bytearray(160)
    extra[0:3] = b"ETS"
    for at, v in ((8, 2), (12, 3), (20, 2), (28, 512), (32, 512), (148, 1), (152, 1)):
        struct.pack_into("<i", extra, at, v)
    extra[108:111] = bytes([n % 256, 128, 255])
    return bytes(head) + bytes(extra) + b"".join(b"\0" * 4 + struct.pack("<4i", *c) + struct.pack("<qI", o, s) + b"\0" * 4 for c, o, s in chunks)


def _files(spark, sf_dir: str, make, ext: str) -> DataFrame:
    build = F.pandas_udf(lambda k: pd.Series([make(int(n)) for n in k], dtype=object), BinaryType())
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(ext)).alias("path"), build("s_suppkey").alias("content"))


@query("vsi_tag_tree", """SELECT 's' || s_suppkey || '.vsi' AS path, k::INT AS pyramid, CASE k WHEN 0 THEN 'slide ' ELSE 'label ' END || s_suppkey AS name, CASE k WHEN 0 THEN 1000 + s_suppkey ELSE 64 END::INT AS width,
  CASE k WHEN 0 THEN 900 + s_suppkey ELSE 32 END::INT AS height, CASE k WHEN 0 THEN 0.25 END::DOUBLE AS psx, CASE k WHEN 0 THEN 0.5 END::DOUBLE AS psy FROM supplier, range(2) t(k)""")
def vsi_tag_tree(spark, sf_dir):
    return slides.parsed(_files(spark, sf_dir, _tree, ".vsi"), slides.pyramid_rows, slides.PYRAMIDS)


@query("ets_chunks", """SELECT 's' || s_suppkey || '.ets' AS path, k::INT AS chunk, [k % 3, k // 3, 0, k % 2]::INT[] AS coord, 1000 * k AS offset, 50 + k AS nbytes, 512 AS tile_w, 512 AS tile_h, 2 AS pixel_type, 3 AS channels,
  2 AS compression, 1 AS pyramid, 1 AS component_order, printf('%02x', s_suppkey % 256) || '80ff' AS background FROM supplier, range(5) t(k) WHERE k <= s_suppkey % 5""")
def ets_chunks(spark, sf_dir):
    return slides.parsed(_files(spark, sf_dir, _tiles, ".ets"), slides.stream_rows, slides.CHUNKS)


@query("dicom_files", f"""SELECT 's' || s_suppkey || '.dcm' AS path, '{WSI_CLASS}' AS sop_class_uid, '1.2.' || s_suppkey % 10 AS series_instance_uid, 'SM' AS modality, '1.2.840.10008.1.2.4.50' AS transfer_syntax_uid, 3 AS n_frames, 1024 AS px_columns, 768 AS px_rows,
  256 AS tile_w, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE 0.25 * (s_suppkey % 8 + 1) * 1000 / 1024 END::DOUBLE AS mpp_x, CASE WHEN s_suppkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * 1000 / 768 END::DOUBLE AS mpp_y, 3 AS spp, CASE WHEN s_suppkey % 7 = 0 THEN 8 END AS profile_bytes, NULL::VARCHAR AS error FROM supplier""")
def dicom_files(spark, sf_dir):
    """Headers of DICOM files, written and read again."""
    found = slides.parsed(_files(spark, sf_dir, _dicom, ".dcm"), slides.dicom_rows, slides.FILES)
    shown = ["path", "sop_class_uid", "series_instance_uid", "modality", "transfer_syntax_uid", "n_frames", "px_columns", "px_rows", "tile_w", "mpp_x", "mpp_y", "spp"]
    return found.select(*shown, F.length("profile").alias("profile_bytes"), "error")


@query("dicom_frames", """SELECT 's' || s_suppkey || '.dcm' AS path, k AS ordinal, CASE WHEN s_suppkey % 3 = 0 THEN k ELSE k * 4 + (s_suppkey + k) % 4 END AS tile_index, 2 * k + 2 AS nbytes FROM supplier, range(3) t(k)""")
def dicom_frames(spark, sf_dir):
    """Each frame's tile and the length of its fragment."""
    return slides.parsed(_files(spark, sf_dir, _dicom, ".dcm"), slides.frame_rows, slides.FRAMES).select("path", "ordinal", "tile_index", "nbytes")


@query("sink_tiff_file")
def sink_tiff_file(spark, sf_dir):
    """Each slide's 16-pixel tiles and their halved level as a BigTIFF, parsed again."""
    return slides.parsed(sink_files(spark, sf_dir).selectExpr("cast(slide AS string) AS path", "content"), slides.tiff_rows, slides.LEVELS)


def sink_files(spark, sf_dir: str) -> DataFrame:
    base = T.quads(X.gray_tiles(spark, sf_dir), ["slide"], "pixels").select("slide", F.col("oc").alias("cx"), F.col("orow").alias("cy"), K.quad_canvas(F.col("quad"), 8).alias("pixels"))
    half = T.quads(base, ["slide"], "pixels").select("slide", F.col("oc").alias("cx"), F.col("orow").alias("cy"), K.box_halved(K.quad_canvas(F.col("quad"), 16), 32).alias("pixels"))
    levels = base.withColumns({"dir": F.lit(0), "side": F.lit(64)}).unionByName(half.withColumns({"dir": F.lit(1), "side": F.lit(32)}))
    raw = F.unhex(F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    fixed = {"tile": F.lit(16), "compression": F.lit(1), "photometric": F.lit(1), "samples": F.lit(1), "mpp": F.pow(F.lit(2.0), F.col("dir")) * 0.5, "description": F.when(F.col("dir") == 0, "raw"), "sub": F.col("dir") > 0}
    rows = levels.withColumns(fixed | {"width": F.col("side"), "height": F.col("side"), "tile_index": F.col("cy") * F.expr("side div 16") + F.col("cx"), "data": raw})
    return tiff_files(rows.drop("pixels", "cx", "cy", "side"))


@query("decode_image")
def decode_image(spark, sf_dir):
    """Every tile as an image file, written by the executors, found and decoded by Spark's image source."""
    root = f"{shared_dir(spark)}/lamella-images-{uuid.uuid4().hex[:12]}"
    build = F.pandas_udf(lambda tiles: pd.Series([_bitmap(p) for p in tiles], dtype=object), BinaryType())
    file = F.concat_ws("-", "slide", "cy", "cx")
    # the text writer puts the bytes down as they are; the line feed that it adds is behind the bitmap's own size
    X.gray_tiles(spark, sf_dir).select(F.concat(file, F.lit(".bmp")).alias("file"), build("pixels").cast("string").alias("value")).write.partitionBy("file").text(root)
    return spark.read.format("image").option("dropInvalid", "true").load(root).select("file", "image.width", "image.height", "image.nChannels", F.md5("image.data").alias("data_md5"))


def _bitmap(pixels: list[int], side: int = 8) -> bytes:
    """A 24-bit BMP, bottom row first."""
    rows = b"".join(bytes(v for p in pixels[y * side : (y + 1) * side] for v in (p, p, p)) for y in reversed(range(side)))
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, side, side, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


@query("incremental_ingest", f"WITH {X.D6_SQL} SELECT status, count(*) AS n, sum(in_bytes)::BIGINT AS in_bytes FROM d6 GROUP BY status")
def incremental_ingest(spark, sf_dir):
    """Two runs over one source: the second finds nothing new."""
    root = f"{shared_dir(spark)}/lamella-ingest-{uuid.uuid4().hex[:12]}"
    source = f"{root}/in"
    X.outcomes(spark, sf_dir).select("slide", "status", "in_bytes").write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest_new(spark, source, schema, f"{root}/out", f"{root}/checkpoint")
    return ingest_new(spark, source, schema, f"{root}/out", f"{root}/checkpoint").groupBy("status").agg(F.count("*").alias("n"), F.sum("in_bytes").alias("in_bytes"))
