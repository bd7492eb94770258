"""Operator 9, language ID by prediction by partial matching.

One variable-order byte context trie per language, with frozen counts; a text's score in each is its exact code
length, and the shortest one wins. The texts are lower-cased first. Only a bounded number of labelled documents per
language (`docs_per_lang`, chosen by a hash of the text, on average) is counted; every text is scored whole.

Defined results: a null text, or one without a letter, is `und` with score 0; on equal code lengths the language that
sorts first wins; with nothing to learn from, everything is `und`; repeated rows are rows; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm import ppm
from lamella.llm.textkit import column_bytes, kept, pieces, tidy
from lamella.workspace import Workspace

ORDER, MIN_SHARE, DOCS_PER_LANG = 4, 1e-4, 1500
UNKNOWN = "und"
#: Languages whose tables a worker holds at a time.
LANGS = 16


def count_grams(order: int, column: str = "text"):
    """For mapInArrow over (grp, text): partial (grp, key, n) rows."""

    def run(batches):
        counter = ppm.Counter()
        for batch in batches:
            buf, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
            grp = batch.column(batch.schema.get_field_index("grp")).to_numpy(zero_copy_only=False)
            for a, b in pieces(off):
                symbols, at = ppm.stream(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                keys, owner = ppm.grams(symbols, at, order), np.repeat(grp[a:b], np.diff(at))
                for g in np.unique(grp[a:b]):
                    counter.add(int(g), keys[owner == g])
            if counter.full():
                yield from counter.rows()
        yield from counter.rows()

    return run


def fit(labelled: DataFrame, order: int = ORDER, min_share: float = MIN_SHARE, docs_per_lang: int = DOCS_PER_LANG, work: Workspace | None = None) -> tuple[list, ppm.Trie | None]:
    """Languages and their tries from labelled (text, lang) rows; rows without either are left out."""
    spark = labelled.sparkSession
    work = work or Workspace(spark, "langid")
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return [], None
    share = spark.createDataFrame([(lang, k, min(1.0, docs_per_lang / n)) for k, (lang, n) in enumerate(counts)], "lang string, grp int, share double")
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("grp", F.lower("text").alias("text"))
    partial = sample.mapInArrow(count_grams(order), ppm.COUNTED)
    counted = work.save(partial.groupBy("grp", "key").agg(F.sum("n").alias("n")), "grams")
    trie = ppm.Trie.build(ppm.contexts(counted, order, min_share), order, len(counts))
    work.drop(counted)
    return [lang for lang, _ in counts], trie


def predict(docs: DataFrame, langs: list, trie: ppm.Trie | None, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keep columns, lang_pred, score of docs (keep, text); score is the posterior of the language under equal priors.

    Only the lower-cased text goes to Python; the other columns wait in the JVM, which spills them. Languages are scored
    LANGS at a time, so that the tables don't grow with their number."""
    spark = docs.sparkSession
    if not langs:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = [spark.sparkContext.broadcast(trie.only(range(a, min(a + LANGS, len(langs))))) for a in range(0, len(langs), LANGS)]
    kind = T.StructType([T.StructField("best", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def bits(texts: pa.Array, model: ppm.Automaton) -> np.ndarray:
        buf, off = column_bytes(texts)
        found = [model.score(*ppm.stream(buf[off[a] : off[b]], off[a : b + 1] - off[a])).reshape(b - a, -1) for a, b in pieces(off)]
        return np.concatenate(found) if found else np.zeros((0, model.trie.n_groups))

    @tidy
    def run(batches):
        for texts in batches:
            each = np.concatenate([bits(texts, model_of(one)) for one in held], axis=1)
            score = 1 / np.exp2(np.maximum(each - each.max(1, keepdims=True), -1000)).sum(1)
            yield pa.StructArray.from_arrays([pa.array(each.argmax(1).astype(np.int32)), pa.array(score)], names=["best", "score"])

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(texts)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # not deterministic: else a filter on the result would have each text scored twice
    guess = F.arrow_udf(found, kind).asNondeterministic()(F.lower(F.coalesce("text", F.lit(""))))
    names = F.array(*map(F.lit, langs))
    out = docs.select(F.struct(*keep).alias("kept"), letters.alias("letters"), guess.alias("guess"))
    return out.select(
        "kept.*",
        F.when(F.col("letters"), F.element_at(names, F.col("guess.best") + 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("guess.score")).otherwise(0.0).alias("score"),
    )


def model_of(held, **kind) -> ppm.Automaton:
    """The broadcast trie's tables, built once in each Python worker."""
    trie = held.value
    return kept((id(trie), *kind), lambda: ppm.Automaton(trie, **kind))


def held_out(parts: int, part: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part


def op9_lang_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, trie = fit(docs.where(~F.coalesce(held_out(3, 1), F.lit(False))))
    out = predict(docs.select("doc_id", "text"), langs, trie)
    return out.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")
