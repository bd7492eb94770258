"""A conversion from a folder of slides to a folder of outputs, with an account of every slide.

Copied as they are: DICOM pyramids, tile by tile, into BigTIFF files (levels below the first directory, or one after
another with `openslide`), and TIFF files that need no change. What would need an encoder, that is every resampled or
recoloured output and slides of several files, fails with its reason in the ledger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.config import JobConfig
from lamella.functions import scalars as S
from lamella.functions.dims import JPEG2000, JPEG_TAG, compression_tag
from lamella.functions.ranged import opened
from lamella.functions.xml import dicom_xml
from lamella.operators import catalog as C
from lamella.operators import containers, ledger, sinks
from lamella.operators.planner import route_action
from lamella.sources import slides
from lamella.workspace import Workspace

LEDGER = "slide string, format string, status string, reason string, in_bytes long, out_bytes long"
NO_ENCODER = "would need an encoder, which isn't built"
NOTHING = "no change asked for"
NO_LEVEL = "no level can be copied"
#: Bytes of a file that are copied at once.
PIECE = 8 << 20


def _put(target: str, pieces) -> int:
    """Bytes written to target, which appears whole or not at all; each try has a name of its own."""
    store, name = opened(target)
    part, n = f"{name}.{uuid.uuid4().hex}.tmp", 0
    try:
        with store.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
                n += len(piece)
        store.move(part, name)
    except Exception:
        store.delete_file(part)
        raise
    return n


def _source(path: str):
    store, name = opened(path)
    with store.open_input_stream(name) as data:
        while piece := data.read(PIECE):
            yield piece


def written(rows: DataFrame, target: str, source: str, whole: bool) -> DataFrame:
    """rows without `source`, with out_bytes and reason: column source (a path to copy, or with whole the bytes) is put to
    the path in column target. A slide that can't be written has null bytes and a reason; the others go on."""
    keep = [c for c in rows.columns if c != source]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, reasons = [], []
            for to, what in zip(batch.column(target), batch.column(source)):
                try:
                    sizes.append(_put(to.as_py(), [what.as_py()] if whole else _source(what.as_py())))
                    reasons.append(None)
                except OSError as e:
                    sizes.append(None)
                    reasons.append(str(e))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(reasons, pa.string())], names=[*keep, "out_bytes", "reason"])

    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{shape}, out_bytes long, reason string")


def _outcomes(rows: DataFrame, form: str) -> DataFrame:
    """Ledger rows of written ones (slide, in_bytes, out_bytes, reason)."""
    return rows.select("slide", F.lit(form).alias("format"), F.when(F.col("reason").isNull(), "OK").otherwise("FAIL").alias("status"), "reason", "in_bytes", "out_bytes")


def _account(rows: DataFrame, form: str, status: str, reason: str) -> DataFrame:
    return rows.select("slide", F.lit(form).alias("format"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), "in_bytes", F.lit(None).cast("long").alias("out_bytes"))


def dicom(files: DataFrame, config: JobConfig, existing: DataFrame, work: Workspace) -> DataFrame:
    """Ledger of the DICOM series among files (path, length)."""
    found = work.save(slides.ranged(files.select("path"), slides.dicom_rows, slides.FILES).join(files.select("path", "length"), "path"), "dicom")
    bad = found.where("error IS NOT NULL").select(F.col("path").alias("slide"), F.lit("dicom").alias("format"), F.lit("FAIL").alias("status"), F.col("error").alias("reason"), F.col("length").alias("in_bytes"), F.lit(None).cast("long").alias("out_bytes"))
    good = found.where("error IS NULL").withColumnsRenamed({"sop_class_uid": "sop_class", "series_instance_uid": "series", "transfer_syntax_uid": "transfer_syntax", "mpp_x": "mpp"}).withColumn("tile", F.col("tile_w"))
    levels = C.resolution_groups(C.volume_levels(C.wsi_only(good)), ["path"])
    ext = ".tiff" if config.openslide else ".ome.tiff"
    folder = F.regexp_extract(F.min_by("path", "ord"), r"([^/]*)/[^/]*$", 1)
    name = F.coalesce(F.nullif(folder, F.lit("")), F.col("series")) if config.use_parent_name else F.col("series")
    names = levels.groupBy("series").agg(S.sanitize_stem(name).alias("stem"), F.sum("length").alias("in_bytes"), F.bool_or(F.col("transfer_syntax").isin(JPEG2000)).alias("jp2k"))
    names = work.save(names.withColumn("slide", F.concat("stem", F.lit(ext))), "names")
    todo = sinks.without_output(names, existing, (ext,))
    skipped = _account(names.join(todo.select("series"), "series", "left_anti"), "dicom", "SKIP", ledger.EXISTS)
    able = F.lit(config.scale is None and not config.icc_bake) & ~(F.col("jp2k") & F.lit(config.openslide))
    failed = _account(todo.where(~able), "dicom", "FAIL", NO_ENCODER)
    jpeg = compression_tag(F.col("transfer_syntax")) == JPEG_TAG
    aligned = (F.col("tile_w") % 16 == 0) & (F.col("tile_h") % 16 == 0)
    own = containers.tiled_only(levels).where(~jpeg | aligned).where("tile_w = tile_h").join(todo.where(able).select("series", "stem", "slide", "in_bytes"), "series")
    head = own.groupBy("series", "group_no").agg(*(F.min_by(c, "ord").alias(f"g_{c}") for c in ("px_columns", "px_rows", "tile", "mpp", "mpp_y", "transfer_syntax", "photometric", "spp")))
    own = work.save(own.select("path", "series", "slide", "group_no", "in_bytes").join(head, ["series", "group_no"]), "levels")
    first = own.groupBy("series").agg(F.min("group_no").alias("top"))
    frames = slides.ranged(own.select("path"), slides.frame_rows, slides.FRAMES).join(own, "path").join(first, "series")
    tiles = containers.filled(slides.read_ranges(frames.repartition("path").sortWithinPartitions("path", "ordinal")))
    space = C.color_space(F.col("g_photometric"), F.lit(None).cast("int"), F.col("g_spp"))
    below = F.col("group_no") > F.col("top")
    text = dicom_xml(F.col("g_px_columns"), F.col("g_px_rows"), F.col("g_mpp"), F.col("g_mpp_y"), F.lit(8), F.col("g_spp"), F.lit(None).cast("string"))
    rows = tiles.select(
        "slide",
        F.col("group_no").cast("int").alias("dir"),
        (below & F.lit(not config.openslide)).alias("sub"),
        F.col("g_px_columns").alias("width"),
        F.col("g_px_rows").alias("height"),
        F.col("g_tile").alias("tile"),
        compression_tag(F.col("g_transfer_syntax")).alias("compression"),
        F.when(space == "Grayscale", sinks.MINISBLACK).when(space == "YCbCr", sinks.YCBCR).otherwise(sinks.RGB).alias("photometric"),
        F.col("g_spp").alias("samples"),
        F.col("g_mpp").alias("mpp"),
        F.when(~below & F.lit(not config.openslide), text).alias("description"),
        "tile_index",
        "data",
    )
    made = sinks.tiff_files(rows).withColumn("target", F.concat(F.lit(f"{config.output_dir}/"), "slide"))
    made = work.save(written(made, "target", "content", True), "made").join(names.select("slide", "in_bytes"), "slide")
    empty = _account(todo.where(able).join(made.select("slide"), "slide", "left_anti"), "dicom", "FAIL", NO_LEVEL)
    return bad.unionByName(skipped).unionByName(failed).unionByName(empty).unionByName(_outcomes(made, "dicom"))


def tiff(files: DataFrame, config: JobConfig, existing: DataFrame, work: Workspace) -> DataFrame:
    """Ledger of the TIFF files among files (path, length)."""
    levels = slides.ranged(files.select("path"), slides.tiff_rows, slides.LEVELS)
    mpp = S.tiff_mpp(F.col("x_resolution"), F.col("y_resolution"), F.col("unit"))
    top = levels.groupBy("path").agg(F.min_by(F.struct(mpp.alias("mpp"), "has_profile", "error"), F.struct(F.col("chain") != "main", "dir")).alias("top"))
    kind, number = config.scale_kind
    action = F.when(F.col("top.error").isNotNull(), "bad").otherwise(route_action(F.col("top.mpp"), F.coalesce("top.has_profile", F.lit(False)), kind, config.icc_bake, number))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.join(top, "path").select("path", name.alias("slide"), F.col("length").alias("in_bytes"), S.tiff_stem(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), action.alias("action"), "top.error")
    rows = work.save(rows, "routes")
    todo = sinks.without_output(rows, existing)
    skipped = _account(rows.join(todo.select("path"), "path", "left_anti"), "tiff", "SKIP", ledger.EXISTS)
    copies = todo.where("action = 'copy'").select("slide", "in_bytes", "path", F.concat(F.lit(f"{config.output_dir}/"), "slide").alias("target"))
    out = skipped.unionByName(_outcomes(work.save(written(copies, "target", "path", False), "copies"), "tiff"))
    for test, status, reason in (("action = 'bad'", "FAIL", "not a TIFF"), ("action = 'untouched'", "SKIP", NOTHING), ("action = 'skip'", "SKIP", ledger.NO_SCALE), ("action IN ('bake', 'resample', 'error')", "FAIL", NO_ENCODER)):
        out = out.unionByName(_account(todo.where(test), "tiff", status, reason))
    return out


def run(spark: SparkSession, config: JobConfig) -> DataFrame:
    """Converts config.input_dir into config.output_dir and returns the ledger, one row a slide."""
    config.check_paths()
    store, out = opened(config.output_dir)
    store.create_dir(out, recursive=False)
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(out)):  # what an earlier run left unfinished
        if info.is_file and info.base_name.endswith(".tmp"):
            store.delete_file(info.path)
    names = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(out)) if i.is_file]
    existing = spark.createDataFrame(names, "path string")
    work = Workspace(spark, "run")
    files = work.save(slides.list_files(spark, config.input_dir), "files")
    found = dicom(files.where("bucket = 'dicom'"), config, existing, work).unionByName(tiff(files.where("bucket = 'tiff'"), config, existing, work))
    for form in ("vsi", "mirax"):
        others = files.where(F.col("bucket") == form).select(F.col("path").alias("slide"), F.col("length").alias("in_bytes"))
        found = found.unionByName(_account(others, form, "FAIL", NO_ENCODER))
    found = work.save(found, "ledger")
    if config.log_file:
        write_log(found, config)
    return found


def write_log(found: DataFrame, config: JobConfig) -> None:
    """A header of the options, then a line for each slide by its name, as text files in order, replacing older ones."""
    head = found.sparkSession.createDataFrame(list(enumerate(config.header())), "n long, line string").withColumn("slide", F.lit(""))
    line = ledger.log_line(F.col("status"), F.lit(""), F.col("slide"), F.coalesce("in_bytes", F.lit(0)), F.coalesce("out_bytes", F.lit(0)), F.coalesce("reason", F.lit("")))
    body = found.select(F.lit(1 << 40).alias("n"), line.alias("line"), "slide")
    head.unionByName(body).orderBy("n", "slide").select("line").write.mode("overwrite").text(config.log_file)
