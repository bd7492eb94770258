"""Byte formats: vectors, round trips, files through the data sources."""

import hashlib
import struct

from lamella.functions import binfmt as B
from lamella.functions import jpeg as J
from lamella.plans import fixtures as X
from lamella.plans.codec_queries import _tiles, _tree, decode_image
from lamella.sources import slides

STREAM = bytes.fromhex("FFD8FFE000040000FFDB0004AABBFFC00005010203FFC40003CCFFDA00030199FFD9")


def test_split_and_rejoin():
    tables, tile = J.split(STREAM)
    assert tables == bytes.fromhex("FFD8FFDB0004AABBFFC40003CCFFD9")
    assert tile == bytes.fromhex("FFD8FFC00005010203FFDA00030199FFD9")
    assert J.split(J.rejoin(tables, tile)) == (tables, tile)
    assert J.app14_transform(J.rejoin(tables, tile, rgb=True)) == 0
    for bad in (None, b"", b"\xff\xd8", STREAM[:12], b"xx" + STREAM):
        assert J.split(bad) is None


def test_subsampling():
    frame = "FFD8FFC000110800100010030122000211010311 01".replace(" ", "")
    tail = "FFDA000301"
    assert J.subsampling(bytes.fromhex(frame + tail)) == (2, 2)
    assert J.subsampling(bytes.fromhex(frame.replace("0122", "0121") + tail)) == (2, 1)
    assert J.subsampling(b"no") is None and J.subsampling(None) is None


def test_tag_tree():
    found, fields = B.tag_tree(_tree(7))
    assert [(p.name, p.width, p.height, p.psx, p.psy) for p in found] == [("slide 7", 1007, 907, 0.25, 0.5), ("label 7", 64, 32, None, None)]
    assert len(fields) == 15 and max(f[0] for f in fields) == 1
    whole = _tree(7)
    for cut in range(0, len(whole), 5):
        B.tag_tree(whole[:cut])
    assert B.tag_tree(b"")[0] == []


def test_streams_that_end_early():
    whole = STREAM
    assert J.split(whole[:2] + b"\xff\xd8" + whole[2:]) == J.split(whole)
    frame = bytes.fromhex("FFD8FFC00011080010001003012200021101031101")
    assert J.subsampling(frame) == (2, 2) and J.subsampling(frame[:2] + b"\xff\xd0\xff\x01" + frame[2:]) == (2, 2)
    assert J.split(frame) == (b"\xff\xd8\xff\xd9", frame)


def test_dicom(tmp_path, spark):
    from lamella.functions import dicom as D
    from lamella.functions.ranged import Ranged
    from lamella.plans.codec_queries import _dicom

    for n in (0, 1, 7):
        (tmp_path / f"{n}.dcm").write_bytes(_dicom(n))
    (tmp_path / "bad.dcm").write_bytes(b"no")
    slides.register(spark)
    names = [str(tmp_path / f"{n}.dcm") for n in (0, 1, 7, "bad")]
    files = {r.path: r for r in spark.read.format("dicom_files").option("paths", "\n".join(names)).load().collect()}
    assert files[names[3]].error and files[names[3]].modality is None
    assert (files[names[0]].mpp_x, files[names[0]].mpp_y, files[names[0]].profile) == (0.5, 1.0, b"profile!") and files[names[1]].profile is None
    frames = spark.read.format("dicom_frames").option("paths", "\n".join(names)).load()
    got = {(r.path, r.ordinal): (r.tile_index, r.data) for r in slides.read_ranges(frames).collect()}
    assert len(got) == 9 and all(v[1] == bytes([k] * (2 * k + 2)) for (_, k), v in got.items())
    assert [got[names[1], k][0] for k in range(3)] == [1, 6, 11] and [got[names[0], k][0] for k in range(3)] == [0, 1, 2]
    with Ranged(names[1]) as data:
        assert len(data) == len(_dicom(1)) and data[130:140] == _dicom(1)[130:140] and D.dataset(data) == D.dataset(_dicom(1))
    implicit = D.file(D.IMPLICIT, [], [])
    assert D.dataset(implicit)[0] == D.IMPLICIT
    for cut in range(0, len(_dicom(1)), 7):
        slides.dicom_rows("x", _dicom(1)[:cut])


def test_page_hops(spark):
    from lamella.operators.tiles import page_hops

    rows = [(1, k, k + 1 if k < 99 else None) for k in range(100)] + [(2, 5, 3), (2, 3, 9), (2, 9, None), (3, 1, 2), (3, 2, 1)]
    got = {(r.slide, r.page): r.hop for r in page_hops(spark.createDataFrame(rows, "slide long, page long, next long")).collect()}
    assert got == {(1, k): k for k in range(100)} | {(2, 5): 0, (2, 3): 1, (2, 9): 2}


def test_tile_stream():
    found = B.tile_stream(_tiles(4))
    assert found["tile_w"] == 512 and len(found["chunks"]) == 5 and found["chunks"][4] == ([1, 1, 0, 0], 4000, 54)
    assert len(B.tile_stream(_tiles(4)[:-10])["chunks"]) == 4
    assert B.tile_stream(b"SISx") is None


def test_linked_pages():
    data = bytearray(400)
    put = lambda at, *v: struct.pack_into(f"<{len(v)}i", data, at, *v)
    put(0, 40)
    put(40, 80)
    put(80, 0, 120)
    put(120, 2, 200, 5, 100, 10, 0, -1, 1, 1, 1)
    put(200, 1, 0, 6, 200, 20, 1)
    assert B.page_list(bytes(data), 0) == [(5, 100, 10, 0), (6, 200, 20, 1)]
    put(200, 1, 120)
    assert len(B.page_list(bytes(data), 0)) == 2
    assert B.position_buffer(struct.pack("<BiiBii", 0, 1, -2, 0, 3, 4), 2) == [(1, -2), (3, 4)]
    assert B.position_buffer(b"123", 2) is None


def tiff(path, subs):
    """A classic TIFF: a tiled directory, with tiled sub-directories or a further main one."""
    def entries(width, extra=()):
        rows = [(256, 4, 1, width), (257, 4, 1, width), (322, 4, 1, 256), (323, 4, 1, 256), (259, 3, 1, 7), *extra]
        return struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in sorted(rows))

    size = len(entries(1)) + 4
    first = 8 + size + (12 if subs else 0)
    if subs:
        data = struct.pack("<2sHI", b"II", 42, 8) + entries(4096, [(330, 4, 1, first)]) + struct.pack("<I", 0) + entries(2048) + struct.pack("<I", 0)
    else:
        data = struct.pack("<2sHI", b"II", 42, 8) + entries(4096) + struct.pack("<I", first) + entries(1024) + struct.pack("<I", 0)
    path.write_bytes(data)


def test_tiff_source(spark, tmp_path):
    tiff(tmp_path / "a.tiff", True)
    tiff(tmp_path / "b.SVS", False)
    (tmp_path / "c.tiff").write_bytes(b"broken")
    (tmp_path / "d.tif").write_bytes(b"not listed")
    files = slides.list_files(spark, f"file://{tmp_path}")
    assert sorted((r.path.rsplit("/", 1)[1], r.bucket) for r in files.collect()) == [("a.tiff", "tiff"), ("b.SVS", "tiff"), ("c.tiff", "tiff")]
    slides.register(spark)
    read = spark.read.format("tiff_directories").option("paths", "\n".join(r.path for r in files.collect())).load()
    found = sorted((r.path[-5:], r.chain, r.width, r.compression) for r in slides.tiff_pyramid(read).collect())
    assert found == [("b.SVS", "main", 1024, 7), ("b.SVS", "main", 4096, 7), (".tiff", "main", 4096, 7), (".tiff", "sub", 2048, 7)] or {f[2] for f in found} == {4096, 2048, 1024}
    assert [r.error for r in read.where("error IS NOT NULL").collect()] == ["not a TIFF"]
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.tiff")
    assert slides.parsed(raw, slides.tiff_rows, slides.LEVELS).where("error IS NULL").count() == 2


def test_ingest(spark, tmp_path):
    from lamella.streaming.ingest import ingest_new

    source, out, done = (f"file://{tmp_path}/{x}" for x in ("in", "out", "done"))
    spark.range(5).write.parquet(source)
    assert ingest_new(spark, source, "id long", out, done).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    assert sorted(r.id for r in ingest_new(spark, source, "id long", out, done).collect()) == list(range(8))


def test_bigtiff_round_trip():
    from lamella.functions.tiffout import TILE_COUNTS, TILE_OFFSETS, Directory, bigtiff

    tiles = [bytes([k]) * 256 for k in range(4)]
    base = Directory(32, 32, 16, [tiles[0], None, tiles[2], tiles[3]], mpp=0.25, description="x" * 20, profile=b"icc")
    data = bigtiff([base, Directory(16, 16, 16, [tiles[1]], sub=True, subfile=1), Directory(16, 16, 16, [tiles[3]], subfile=1)])
    found = B.tiff_directories(data)
    assert [(d["chain"], d["tags"][B.WIDTH][0]) for d in found] == [("main", 32), ("main", 16), ("sub", 16)]
    tags = found[0]["tags"]
    assert tags[B.DESCRIPTION] == "x" * 20 and tags[B.PROFILE] == b"icc" and tags[B.X_RES] == [40000.0] and tags[B.UNIT] == [3]
    got = [data[a : a + n] for a, n in zip(tags[TILE_OFFSETS], tags[TILE_COUNTS])]
    assert got == [tiles[0], b"", tiles[2], tiles[3]]


def test_tiff_sink(spark):
    from lamella.functions.tiffout import TILE_COUNTS, TILE_OFFSETS
    from lamella.plans.codec_queries import sink_files
    from lamella.plans.fixtures import gray_tiles

    sf = "/root/testdata/sf0.001"
    content = sink_files(spark, sf).where("slide = 0").first().content
    main, sub = B.tiff_directories(bytes(content))
    assert (main["tags"][B.WIDTH], sub["chain"], sub["tags"][B.WIDTH]) == ([64], "sub", [32])
    first = {(r.cx, r.cy): r.pixels for r in gray_tiles(spark, sf).where("slide = 0 AND cx < 2 AND cy < 2").collect()}
    at, n = main["tags"][TILE_OFFSETS][0], main["tags"][TILE_COUNTS][0]
    tile = list(content[at : at + n])
    assert tile == [first[x // 8, y // 8][y % 8 * 8 + x % 8] for y in range(16) for x in range(16)]


def test_every_tile_is_decoded(spark):
    sf = "/root/testdata/sf0.001"
    tiles = X.gray_tiles(spark, sf).collect()
    want = {(f"{t.slide}-{t.cy}-{t.cx}.bmp", 8, 8, 3, hashlib.md5(bytes(v for y in range(8) for p in t.pixels[y * 8 : y * 8 + 8] for v in (p, p, p))).hexdigest()) for t in tiles}
    assert len(tiles) > 128  # more than the first two slides
    got = decode_image(spark, sf).collect()
    assert len(got) == len(tiles) and {tuple(r) for r in got} == want
