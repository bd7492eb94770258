"""The training-data pipeline: five stages, each on all documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.decontam import leaked
from lamella.llm.langid import UNKNOWN, fit, predict
from lamella.llm.mixing import mix
from lamella.llm.neardup import near_duplicates
from lamella.llm.repair import token_shards
from lamella.workspace import Workspace

#: Least similarity of word shingles at which documents are near-duplicates.
PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """The rows of docs, saved, each with a number of its own: a doc_id may be null or be shared by several."""
    return Workspace(spark, name).save(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or no letter) go; a missing label is filled with the prediction."""
    docs = docs.select(*COLUMNS)
    langs, trie = fit(docs)
    out = predict(docs, langs, trie, COLUMNS).where(F.col("lang_pred") != UNKNOWN)
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id stays, once; null counts as the greatest."""
    rows = _numbered(spark, docs, "dedup")
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    held = leaked(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS, held.alias("leaked")).where("NOT leaked").select(*COLUMNS)


def _placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs with (file, place), which tell them apart: where Parquet files hold them, without a copy."""
    try:
        return docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not straight from files
        return _numbered(spark, docs, "mixture").withColumnRenamed("row", "place").withColumn("file", F.lit(""))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = _placed(spark, docs)
    copies = mix(rows, keep=["file", "place"]).where("copies > 0").select("file", "place", "copies")
    taken = rows.join(copies, ["file", "place"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_shards(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mixture),
    ("token_output", tokens),
]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.save(stage(spark, docs, sf_dir), name)
        if hasattr(before, "lamella_path"):
            work.drop(before)
        work.tidy()
    return STAGES[-1][1](spark, docs, sf_dir)
