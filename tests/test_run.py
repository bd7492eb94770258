"""A folder of slides goes in, files come out and are read again."""

import pytest

from lamella.config import JobConfig
from lamella.functions import binfmt as B
from lamella.functions import tiffout
from lamella.plans.codec_queries import _dicom
from lamella.run import run


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    for n in (1, 7):
        (tmp_path / f"in/a/{n}.dcm").write_bytes(_dicom(n))
    (tmp_path / "in/bad.dcm").write_bytes(b"no")
    plain = tiffout.bigtiff([tiffout.Directory(64, 64, 32, [b"x" * 1024] * 4, mpp=0.5)])
    (tmp_path / "in/native.ome.tiff").write_bytes(plain)
    (tmp_path / "in/s.vsi").write_bytes(b"index")
    (tmp_path / "in/notes.txt").write_bytes(b"no slide")
    return tmp_path


def account(found):
    return {(r.format, r.slide.rsplit("/", 1)[-1]): (r.status, r.in_bytes, r.out_bytes) for r in found.collect()}


def test_passthrough(spark, folder):
    (folder / "out").mkdir()
    (folder / "out/x.tmp").write_bytes(b"left")
    config = JobConfig(str(folder / "in"), str(folder / "out"), log_file=str(folder / "log"))
    got = account(run(spark, config))
    assert {k: v[0] for k, v in got.items()} == {("dicom", "1.2.1.ome.tiff"): "OK", ("dicom", "1.2.7.ome.tiff"): "OK", ("dicom", "bad.dcm"): "FAIL", ("tiff", "native.ome.tiff"): "SKIP", ("vsi", "s.vsi"): "FAIL"}
    assert sorted(p.name for p in (folder / "out").iterdir()) == ["1.2.1.ome.tiff", "1.2.7.ome.tiff"]
    data = (folder / "out/1.2.1.ome.tiff").read_bytes()
    assert got["dicom", "1.2.1.ome.tiff"] == ("OK", len(_dicom(1)), len(data))
    (top,) = B.tiff_directories(data)
    tags = top["tags"]
    assert (tags[B.WIDTH], tags[B.HEIGHT], tags[B.TILE_W], tags[B.COMPRESSION]) == ([1024], [768], [256], [7])
    places = {k: data[a : a + n] for k, (a, n) in enumerate(zip(tags[tiffout.TILE_OFFSETS], tags[tiffout.TILE_COUNTS])) if n}
    assert places == {index: bytes([k] * (2 * k + 2)) for k, index in enumerate((1, 6, 11))}
    lines = [line for p in sorted((folder / "log").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[1] == f"input:  {folder / 'in'}" and lines[7] == "---" and len(lines) == 8 + len(got)
    again = account(run(spark, config))
    assert {v[0] for k, v in again.items() if "1.2." in k[1]} == {"SKIP"}


def test_copies_and_what_fails(spark, folder):
    got = account(run(spark, JobConfig(str(folder / "in"), str(folder / "out"), scale="20x")))
    assert got["tiff", "native.ome.tiff"][0] == "OK"
    assert (folder / "out/native.ome.tiff").read_bytes() == (folder / "in/native.ome.tiff").read_bytes()
    assert {v[0] for k, v in got.items() if k[0] == "dicom"} == {"FAIL"}
    assert [p.name for p in (folder / "out").iterdir()] == ["native.ome.tiff"]


def test_nothing_to_convert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/notes.txt").write_bytes(b"no slide")
    assert run(spark, JobConfig(str(tmp_path / "in"), str(tmp_path / "out"))).count() == 0


def test_paths(tmp_path):
    for given, out in (("none", "out"), ("f.dcm2", "out"), ("", "no/out")):
        (tmp_path / "f.dcm2").write_bytes(b"")
        with pytest.raises(ValueError):
            JobConfig(str(tmp_path / given), str(tmp_path / out)).check_paths()
    JobConfig(str(tmp_path), str(tmp_path / "out")).check_paths()
