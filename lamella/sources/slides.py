"""Sources of slide files. Metadata readers are Python data sources whose partitions are files, so that a file is opened
by the executor that reads it, and of which it reads the blocks that hold headers and tables; tiles are read by range.
Listing comes from Spark's binaryFile source, and so do the bytes of files in stores that only Spark reads (`parsed`)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamella.functions import binfmt as B
from lamella.functions import dicom as D
from lamella.functions.ranged import Ranged
from lamella.operators.catalog import discover

LEVELS = "path string, chain string, dir int, width long, height long, tile_w long, tile_h long, compression int, photometric int, samples int, x_resolution double, y_resolution double, unit int, description string, has_profile boolean, error string"
CHUNKS = "path string, chunk int, coord array<int>, offset long, nbytes long, tile_w int, tile_h int, pixel_type int, channels int, compression int, pyramid int, component_order int, background string"
FILES = "path string, sop_class_uid string, series_instance_uid string, modality string, transfer_syntax_uid string, n_frames long, px_columns long, px_rows long, image_type string, tile_w long, tile_h long, mpp_x double, mpp_y double, objective_power double, spp int, photometric string, profile binary, error string"
FRAMES = "path string, ordinal long, tile_index long, offset long, nbytes long"
PYRAMIDS = "path string, pyramid int, name string, width int, height int, psx double, psy double"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, bucket, dir of slide files under root; links are followed, other files dropped, no byte is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return discover(files)


def tiff_rows(path: str, data: bytes) -> list[tuple]:
    found = B.tiff_directories(data)
    if found is None:
        return [(path, None, None, *[None] * 12, "not a TIFF")]
    rows = []
    for d in found:
        one = lambda tag, default=None, t=d["tags"]: (t.get(tag) or [default])[0]
        rows.append((path, d["chain"], d["dir"], one(B.WIDTH), one(B.HEIGHT), one(B.TILE_W), one(B.TILE_H), one(B.COMPRESSION, 1), one(B.PHOTOMETRIC, 2), one(B.SAMPLES, 3), one(B.X_RES), one(B.Y_RES), one(B.UNIT), d["tags"].get(B.DESCRIPTION), bool(d["tags"].get(B.PROFILE)), None))
    return rows


def stream_rows(path: str, data: bytes) -> list[tuple]:
    found = B.tile_stream(data)
    head = ("tile_w", "tile_h", "pixel_type", "channels", "compression", "pyramid", "component_order")
    return [(path, k, *c, *(found[h] for h in head), found["background"].hex()) for k, c in enumerate(found["chunks"])] if found else []


def dicom_rows(path: str, data: bytes) -> list[tuple]:
    """One row a file; one that can't be read has an error and nothing else."""
    try:
        syntax, found = D.dataset(data)
    except (ValueError, RecursionError) as e:
        return [(path, *[None] * 16, str(e))]
    text = lambda tag: found.text(tag) or ""
    tile = found.number(D.COLUMNS), found.number(D.ROWS)
    tile = tile if None not in tile else (None, None)
    counts = (found.number(tag) for tag in (D.FRAMES, D.MATRIX_COLUMNS, D.MATRIX_ROWS))
    samples = found.number(D.SAMPLES)
    return [(path, text(D.SOP_CLASS), text(D.SERIES), text(D.MODALITY), syntax, *counts, found.text(D.IMAGE_TYPE), *tile, *D.spacing(found), found.number(D.POWER, float), 3 if samples is None else samples, found.text(D.PHOTOMETRIC), D.profile(found), None)]


def frame_rows(path: str, data: bytes) -> list[tuple]:
    try:
        _, found = D.dataset(data)
    except (ValueError, RecursionError):
        return []
    return [(path, *f) for f in D.frames(found)]


def read_ranges(rows: DataFrame) -> DataFrame:
    """rows (path, offset, nbytes and others) with `data`, the bytes of each range; null where nothing is there. A task
    opens a file once for the rows that follow each other."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema, T.StructField("data", T.BinaryType())])
    names = [*rows.columns, "data"]
    at = [names.index(c) for c in ("path", "offset", "nbytes")]

    def run(batches):
        name, file = None, None
        for batch in batches:
            paths, offsets, sizes = (batch.column(k).to_pylist() for k in at)
            out, held, start = [], 0, 0
            for k, (path, offset, size) in enumerate(zip(paths, offsets, sizes)):
                if path != name:
                    if file is not None:
                        file.__exit__()
                    name, file = path, Ranged(path)
                fits = offset is not None and size and 0 <= offset < len(file)
                out.append(file[offset : offset + size] if fits else None)
                held += len(out[-1] or b"")
                if held > 32 << 20 or k + 1 == len(paths):
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(out)).columns, pa.array(out, pa.binary())], names=names)
                    out, held, start = [], 0, k + 1
        if file is not None:
            file.__exit__()

    return rows.mapInArrow(run, schema)


def pyramid_rows(path: str, data: bytes) -> list[tuple]:
    return [(path, k, p.name, p.width, p.height, p.psx, p.psy) for k, p in enumerate(B.tag_tree(data)[0])]


def parsed(files: DataFrame, rows, schema: str) -> DataFrame:
    """rows(path, bytes) of binaryFile rows, in Arrow batches: the form for stores that only Spark reads."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            out = [r for path, data in zip(batch.column(0).to_pylist(), batch.column(1)) for r in rows(path, data.as_py() or b"")]
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], schema=shape)

    return files.select("path", "content").mapInArrow(run, schema)


def ranged(files: DataFrame, rows, schema: str) -> DataFrame:
    """rows(path, data) of files (path), each read by range in the task that has its row; no name goes to the driver."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with Ranged(path) as data:
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows(path, data)], schema=shape)

    return files.select("path").mapInArrow(run, schema)


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rows):
        self.paths, self.rows = paths, rows

    def partitions(self):
        return [_Path(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with Ranged(partition.path) as data:
            yield from self.rows(partition.path, data)


class _Source(DataSource):
    rows, shape = staticmethod(tiff_rows), LEVELS

    def schema(self):
        return self.shape

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split("\n") if p], type(self).rows)


class TiffDirectories(_Source):
    @classmethod
    def name(cls):
        return "tiff_directories"


class TileStreams(_Source):
    rows, shape = staticmethod(stream_rows), CHUNKS

    @classmethod
    def name(cls):
        return "tile_streams"


class TaggedPyramids(_Source):
    rows, shape = staticmethod(pyramid_rows), PYRAMIDS

    @classmethod
    def name(cls):
        return "tagged_pyramids"


class DicomFiles(_Source):
    rows, shape = staticmethod(dicom_rows), FILES

    @classmethod
    def name(cls):
        return "dicom_files"


class DicomFrames(_Source):
    rows, shape = staticmethod(frame_rows), FRAMES

    @classmethod
    def name(cls):
        return "dicom_frames"


def register(spark: SparkSession) -> None:
    for source in (TiffDirectories, TileStreams, TaggedPyramids, DicomFiles, DicomFrames):
        spark.dataSource.register(source)


def tiff_pyramid(directories: DataFrame) -> DataFrame:
    """The directories that are levels: a tiled first one, and its sub-directories or else the other tiled ones."""
    from pyspark.sql import Window

    slide = Window.partitionBy("path")
    tiled = "coalesce(tile_w, 0) > 0 AND coalesce(tile_h, 0) > 0"
    rows = directories.where("error IS NULL").withColumns({"fine": F.bool_or(F.expr(f"chain = 'main' AND dir = 0 AND {tiled}")).over(slide), "has_sub": F.bool_or(F.expr("chain = 'sub'")).over(slide)})
    return rows.where(f"fine AND {tiled} AND (NOT has_sub OR chain = 'sub' OR dir = 0)").drop("fine", "has_sub")
