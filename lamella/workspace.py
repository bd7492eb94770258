"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/lamella-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/") if found else DEFAULT_DIR


class Workspace:
    """One folder per run. Tables are written as Parquet through Spark's commit protocol, so that a lost executor
    costs a retried task and never the lineage before the table. drop() removes what is no longer read; what the
    returned DataFrame still reads stays until its caller removes `root`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lamella-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        if self.root.startswith(f"{DEFAULT_DIR}/"):  # a folder of our own, so local mode: nothing reads it after us
            atexit.register(shutil.rmtree, self.root, ignore_errors=True)

    def save(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.lamella_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if t is not None:
                self._delete(t.lamella_path)

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of finished queries now, and not whenever the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
