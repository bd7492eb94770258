"""Account of every slide: outcome with its reason, run summary, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXISTS, NO_SCALE = "output already exists", "resolution unknown or too coarse for 20x"


def outcome(fmt: Column, usable: Column, exists: Column) -> Column:
    """struct<status, reason>. A slide that can't be scaled is skipped if it is DICOM, and fails otherwise."""
    status = F.when(exists, "SKIP").when(usable, "OK").when(fmt == "dicom", "SKIP").otherwise("FAIL")
    return F.struct(status.alias("status"), F.when(exists, EXISTS).when(~usable, NO_SCALE).alias("reason"))


def summary(ledger: DataFrame) -> DataFrame:
    """One row: counts, bytes of converted slides, and their ratio in percent (0 without input)."""
    done = F.col("status") == "OK"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    out = ledger.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "FAIL", "SKIP")), total("in_bytes"), total("out_bytes"))
    return out.withColumn("ratio", F.round(F.when(F.col("in_bytes") > 0, F.col("out_bytes") / F.col("in_bytes") * 100).otherwise(0.0), 6))


def _padded(text: Column, width: int, left: bool) -> Column:
    pad = F.lpad(text, width, " ") if left else F.rpad(text, width, " ")
    return F.when(F.length(text) < width, pad).otherwise(text)


def log_line(status: Column, number: Column, name: Column, in_bytes: Column, out_bytes: Column, reason: Column) -> Column:
    told = F.when(status == "OK", F.concat(F.lit("in="), in_bytes.cast("string"), F.lit(" out="), out_bytes.cast("string")))
    told = told.when(status == "SKIP", F.concat(F.lit("("), reason, F.lit(")"))).otherwise(reason)
    return F.concat(F.rpad(status, 4, " "), F.lit(" ("), _padded(number.cast("string"), 4, True), F.lit(") "), _padded(name, 52, False), F.lit("  "), told)
