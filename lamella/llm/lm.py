"""Operator 3, language-model scoring by prediction by partial matching.

The model (ppm.py) has the counts of all byte contexts of all training documents, frozen for scoring. It reads the
same event as the word baseline: the lower-cased (A-Z) words of the text, one space between two, and the end. Words
are counted by 64-bit hashes. Words that hold a set share of all training tokens (at most 1 / share of them) are
broadcast; the counts of all others meet their documents in a join, in which no key can be hot. It is the same with
contexts: those with a share of MIN_SHARE of all bytes are broadcast as a trie, the others are a table, and what follows
them in the documents is settled by joins. The shares divide the work only; no count is left out.

Defined results: a null text is empty, and has one token, the end; repeated rows are counted and scored one by one;
without training documents all counts are 0 and scores come from the uniform distribution; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lamella.llm import ppm
from lamella.llm.langid import held_out, model_of
from lamella.llm.textkit import IS_SPACE, LOWER, Words, column_bytes, pieces, tidy
from lamella.workspace import Workspace

ORDER, MIN_SHARE = 5, 1e-6
#: A word with this share of all tokens is broadcast.
HEAVY = 1 / 50_000
BYTES, WORDS = 0, 1
END = np.uint64(0)


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space between them: bytes, offsets."""
    keep = ~IS_SPACE[words.buf]
    inner = np.ones(len(words.starts), bool)
    inner[words.first[1:][np.diff(words.first) > 0] - 1] = False
    keep[words.ends[inner]] = True
    out = LOWER[words.buf]
    out[IS_SPACE[words.buf]] = 0x20
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[words.off]


def _each(batch, column: int):
    buf, off = column_bytes(batch.column(column))
    for a, b in pieces(off):
        yield a, b, Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def _count(order: int):
    def run(batches):
        counter, docs = ppm.Counter(), 0
        for batch in batches:
            for a, b, words in _each(batch, 0):
                symbols, at = ppm.stream(*canonical(words))
                counter.add(BYTES, ppm.grams(symbols, at, order))
                counter.add(WORDS, words.hashes())
                docs += b - a
            if counter.full():
                yield from counter.rows()
        counter.add(WORDS, np.array([END]), np.array([docs]))
        yield from counter.rows()

    return run


TIMES = "array<struct<key long, times int>>"
SCORED = f"row long, doc_id long, score double, n_tokens long, known long, logs double, rare {TIMES}, deep {TIMES}"


def _by_doc(keys: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Each document's distinct keys and how often it has them."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys))).astype(np.int32)
    offsets = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(times)], names=["key", "times"]))


def _score(trie, heavy):
    def run(batches):
        model = model_of(trie, whole_only=True)
        keys, counts = heavy.value
        logs = np.log10(counts + 0.5)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for a, b, words in _each(batch, 1):
                n = b - a
                symbols, start = ppm.stream(*canonical(words))
                bits = model.sure(symbols)
                open_ = np.flatnonzero(np.isnan(bits))
                bits[open_] = 0
                deep = _by_doc(ppm.grams(symbols, start, model.order)[open_], np.searchsorted(start, open_, "right") - 1, n)
                hashes, owner = words.hashes(), words.doc()
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = (keys[at] == hashes) if len(keys) else np.zeros(len(hashes), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(a, n),
                        pa.array((np.add.reduceat(bits, start[:-1], dtype=np.float64) if n else np.zeros(0)) * np.log10(2)),
                        pa.array(np.diff(words.first) + 1),
                        pa.array(np.bincount(owner[hit], minlength=n).astype(np.int64)),
                        pa.array(np.bincount(owner[hit], logs[at[hit]], n) if len(logs) else np.zeros(n)),
                        _by_doc(hashes[~hit], owner[~hit], n),
                        deep,
                    ],
                    names=["row", "doc_id", "score", "n_tokens", "known", "logs", "rare", "deep"],
                )
                row += n

    return run


def _levels(trie):
    """(own, at): for each context asked for, itself and its suffixes that the trie lacks, the depth on top of each."""

    def run(batches):
        keys = trie.value.keys
        for batch in batches:
            own = batch.column(0).to_numpy()
            for d, mine in enumerate(keys):
                mask = (1 << 8 * d) - 1
                lack = own[(own >> 56 >= d) & ~np.isin(own & mask, mine)]
                yield pa.RecordBatch.from_arrays([pa.array(lack), pa.array((lack & mask) | (d << 56))], names=["own", "at"])

    return run


def _behind(trie):
    """(key, bits) of rows (own, syms, chain): symbols asked for behind a context, and its rows of the table of contexts."""

    def run(batches):
        model = model_of(trie, whole_only=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, syms, chain = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            many = np.diff(syms.offsets.to_numpy())
            own, sym = np.repeat(own, many), syms.flatten().to_numpy()
            links = chain.flatten()
            at, first = np.unique(links.field("at").to_numpy(), return_index=True)
            lists = links.field("symbols").take(pa.array(first))
            entry, at = lists.flatten(), np.repeat(at, np.diff(lists.offsets.to_numpy()))
            body = (1 << 56) - 1
            rare = at >> 56, at & body, entry.field("sym").to_numpy(), entry.field("n").to_numpy().astype(np.float64)
            bits = model.behind(own >> 56, own & body, sym, rare)
            key = (((own >> 56) + 1) << 56) | ((own & body) << 8) | sym
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits.astype(np.float64))], names=["key", "bits"])

    return run


def _deep_bits(deep: DataFrame, rare: DataFrame, trie, work: Workspace) -> DataFrame:
    """(row, deep_bits): log2 probability of deep (row, key, times), the grams whose longest context isn't in the trie."""
    own = (F.shiftright("key", 56) - 1).bitwiseAND(F.lit(255))
    context = F.shiftleft(own, 56).bitwiseOR(F.expr("shiftright(key & 72057594037927935L, 8)"))
    asked = deep.groupBy(context.alias("own")).agg(F.collect_set(F.col("key").bitwiseAND(F.lit(255))).alias("syms"))
    asked = work.save(asked, "asked")
    chain = asked.select("own").mapInArrow(_levels(trie), "own long, at long").join(rare, "at").groupBy("own").agg(F.collect_list(F.struct("at", "symbols")).alias("chain"))
    none = F.expr("CAST(array() AS array<struct<at: bigint, symbols: array<struct<sym: int, n: bigint>>>>)")
    bits = asked.join(chain, "own", "left").select("own", "syms", F.coalesce("chain", none).alias("chain")).mapInArrow(tidy(_behind(trie)), "key long, bits double")
    return deep.join(work.save(bits, "bits"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("bits")).alias("deep_bits"))


def lm_score(train: DataFrame, docs: DataFrame, order: int = ORDER, min_share: float = MIN_SHARE, heavy_share: float = HEAVY, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text), learned from train (text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    counted = work.save(train.select("text").mapInArrow(tidy(_count(order)), ppm.COUNTED).groupBy("grp", "key").agg(F.sum("n").alias("n")), "counts")
    every = work.save(ppm.all_contexts(counted.where(F.col("grp") == BYTES), min_share), "contexts")
    trie = spark.sparkContext.broadcast(ppm.Trie.build(every.where("heavy").drop("heavy").toArrow(), order, 1))
    words = counted.where((F.col("grp") == WORDS) & (F.col("n") > 0)).select("key", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= F.lit(max(1.0, tokens * heavy_share)))
    found = frequent.where("key != 0").toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by_key = np.argsort(keys)
    ends = words.where("key = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = spark.sparkContext.broadcast((keys[by_key], counts[by_key]))
    scored = work.save(docs.select("doc_id", "text").mapInArrow(tidy(_score(trie, heavy)), SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times")
    tail = (
        rare.join(words, "key")  # a rare word without a count stays out here and is counted below
        .groupBy("row")
        .agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("tail_logs"))
    )
    others = every.where("NOT heavy").select(F.shiftleft(F.col("depth").cast("long"), 56).bitwiseOR(F.col("ctx")).alias("at"), "symbols")
    deep = _deep_bits(scored.select("row", F.explode("deep").alias("d")).select("row", "d.key", "d.times"), others, trie, work)
    bottom = float(np.log10(tokens + 0.5 * (kinds + 1)))
    inner = F.col("n_tokens") - 1
    unknown = (inner - F.col("known")) * F.log10(F.lit(0.5))  # as if no rare word had a count; the tail mends that
    base = F.col("logs") + unknown + F.coalesce("tail_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * bottom
    return scored.drop("rare", "deep").join(tail, "row", "left").join(deep, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("deep_bits", F.lit(0.0)) * float(np.log10(2))).alias("score"),
    )


def op3_lm_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.coalesce(held_out(5, 1), F.lit(False))
    return lm_score(docs.where(~out), docs).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
