"""Operator 4, token-ID output: shards of ids under a Re-Pair grammar.

Documents are range-partitioned and sorted by doc_id, encoded whole, closed with an end id, and packed into shards of
whole documents with about SHARD_IDS ids. In each shard frequent pairs of adjacent symbols become nonterminals, many
pairs a round, the most frequent ones first where occurrences overlap; no pair takes in an end id, so a document is a
run of symbols. A shard is one value in the layout below, and shards are rows of a Parquet table, written through
Spark's commit protocol on whatever store the workspace is, with the number of ids before them in their partition.

Layout, little-endian: magic `RPR1`; u32 terminals, rules, documents, symbols, ids; i64 doc_id of each document and a
byte each that is 1 where it is null; u32 number of symbols of each document; u32 number of ids of each document; for
each rule u32 left, u32 right, u32 expansion length; the symbols, u16 if terminals + rules <= 65536, else u32.
Expansion lengths and document starts let `read_document` and `read_ids` decode a part of a shard alone.

Defined results: a null or empty text is the end id alone; rows with a null doc_id come first; repeated doc_ids are
documents of their own, in order of their texts; an empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lamella.llm.encode import Encoder
from lamella.llm.textkit import kept, tidy
from lamella.workspace import Workspace

SHARD_IDS, END_ID = 1 << 19, 0
PER_ROUND, LEAST_USES, LEAST_GAIN = 4096, 8, 0.01
MAGIC = b"RPR1"
_HEAD = struct.Struct("<4s5I")


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def repair(ids: np.ndarray, terminals: int, end_id: int = END_ID, per_round: int = PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) whose expansion is ids: round after round, until no pair is used LEAST_USES times or
    a round takes away less than LEAST_GAIN of the symbols."""
    s, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)]
    made = 0
    while len(s) > 1:
        before = len(s)
        code = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
        free = np.flatnonzero((s[:-1] != end_id) & (s[1:] != end_id))
        slot = _slot(code[free])
        in_slot = np.bincount(slot, minlength=1 << 20)
        full = in_slot[in_slot >= LEAST_USES]
        often = in_slot >= (np.partition(full, -2 * per_round)[-2 * per_round] if len(full) > 2 * per_round else LEAST_USES)
        some = often[slot]  # exact counts, for these only
        at, slot = free[some], slot[some]
        code = code[at]
        pair, uses = np.unique(code, return_counts=True)
        top = np.lexsort((pair, -uses))[:per_round]
        top = top[uses[top] >= LEAST_USES]
        if not len(top):
            break
        # where two share a slot, the more frequent one comes last and stays; the other one has a later round
        at_slot = np.full(1 << 20, -1, np.int64)
        at_slot[_slot(pair[top[::-1]])] = np.arange(len(top))[::-1]
        rank = at_slot[slot]
        hit = np.flatnonzero(rank >= 0)
        hit = hit[pair[top][rank[hit]] == code[hit]]
        at, rank = at[hit], rank[hit]
        take = np.zeros(len(at), bool)
        open_ = np.ones(len(at), bool)
        touch = at[1:] == at[:-1] + 1
        for _ in range(2):  # an occurrence wins over overlapping ones of rarer pairs; of equal ones the left one wins
            value = np.where(open_, rank, 1 << 30)
            win = open_.copy()
            win[1:] &= ~touch | (value[1:] < value[:-1])
            win[:-1] &= ~touch | (value[:-1] <= value[1:])
            take |= win
            open_ &= ~win
            open_[1:][touch & win[:-1]] = False
            open_[:-1][touch & win[1:]] = False
        uses = np.bincount(rank[take], minlength=len(top))
        worth = uses > 1  # a rule takes as much as it saves if used once
        if not worth.any():
            break
        take &= worth[rank]
        chosen, new = pair[top][worth], (np.cumsum(worth) - 1)[rank[take]]
        first = at[take]
        s[first] = terminals + made + new
        keep = np.ones(len(s), bool)
        keep[first + 1] = False
        s = s[keep]
        made += len(chosen)
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        if before - len(s) < LEAST_GAIN * before:
            break
    return s, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Of all symbols; a rule's parts come before it."""
    out = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[terminals + k] = out[a] + out[b]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    s = symbols.astype(np.uint32)
    left, right = rules[:, 0].astype(np.uint32), rules[:, 1].astype(np.uint32)
    while True:
        big = np.flatnonzero(s >= terminals)
        if not len(big):
            return s
        rule = s[big] - np.uint32(terminals)
        s[big] = left[rule]
        s = np.insert(s, big + 1, right[rule])


def pack(doc_ids: list, ids: np.ndarray, off: np.ndarray, terminals: int, end_id: int = END_ID) -> bytes:
    """A shard of documents; each one's ids end with the end id."""
    symbols, rules = repair(ids, terminals, end_id)
    length = expansion_lengths(rules, terminals)
    at = np.concatenate([[0], np.cumsum(length[symbols])])
    first = np.searchsorted(at, off)
    wide = "<u2" if terminals + len(rules) <= 65536 else "<u4"
    return b"".join(
        [
            _HEAD.pack(MAGIC, terminals, len(rules), len(doc_ids), len(symbols), len(ids)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.diff(first).astype("<u4").tobytes(),
            np.diff(off).astype("<u4").tobytes(),
            np.column_stack([rules, length[terminals:]]).astype("<u4").tobytes(),
            symbols.astype(wide).tobytes(),
        ]
    )


class Shard:
    """A packed shard, with random access to documents and ids."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, n_docs, n_symbols, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.symbol_off = np.concatenate([[0], np.cumsum(take("<u4", n_docs), dtype=np.int64)])
        self.off = np.concatenate([[0], np.cumsum(take("<u4", n_docs), dtype=np.int64)])
        table = take("<u4", 3 * n_rules).reshape(-1, 3).astype(np.int64)
        self.rules = table[:, :2]
        self.length = np.concatenate([np.ones(self.terminals, np.int64), table[:, 2]])
        self.symbols = take("<u2" if self.terminals + n_rules <= 65536 else "<u4", n_symbols)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.terminals)

    def read_document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.symbol_off[k] : self.symbol_off[k + 1]], self.rules, self.terminals)

    def read_ids(self, start: int, count: int) -> np.ndarray:
        """ids[start:start + count], decoding the symbols over them only."""
        ends = np.cumsum(self.length[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, min(start + count, self.n_ids), "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.terminals)[start - before : start - before + count]


FILES = "part int, seq int, before long, ids long, docs long, content binary"


def _write(path: str, end_id: int, shard_ids: int):
    def run(batches):
        model = kept(path, lambda: Encoder(path))
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held, docs, size = [], [], 0

        def flush():
            nonlocal held, docs, size, seq, before
            ids = np.concatenate([x for x, _ in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in held]))]).astype(np.int64)
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (len(docs), pa.int64()))]
            content = pa.array([pack(docs, ids, off, model.size, end_id)], pa.binary())
            held, docs, size, seq, before = [], [], 0, seq + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([*row, content], names=["part", "seq", "before", "ids", "docs", "content"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, ids, off in model.encode(batch.column(1)):
                held.append((np.insert(ids, off[1:], end_id), off + np.arange(b - a + 1)))
                docs += names[a:b]
                size += len(ids) + b - a
                if size >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, work: Workspace, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The saved shards (FILES) of docs (doc_id, text), in ascending order of (part, seq)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return work.save(rows.mapInArrow(tidy(_write(tokenizer, end_id, shard_ids)), FILES), "shards")


def _read(batches):
    for batch in batches:
        for content, start in zip(batch.column(0), batch.column(1).to_pylist()):
            shard = Shard(content.as_buffer())
            ids, off = shard.ids().astype("<u4"), shard.off
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in saved shards; one row a partition goes to the driver."""
    spark = shards.sparkSession
    parts = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    base, total = [], 0
    for part, n in parts:
        base.append((part, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    placed = shards.select("part", "before", "content").join(bases, "part").select("content", (F.col("base") + F.col("before")).alias("start"))
    return placed.mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: str | None = None, work: Workspace | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_shards(write_shards(docs, str(tokenizer), work or Workspace(docs.sparkSession, "tokens")))


def op4_tokens_repair(spark, sf_dir: str) -> DataFrame:
    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
