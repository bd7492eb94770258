"""Operator 6, benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The test items are an inverted index; each training document is cut into passages of `window` words that overlap by
half, and each passage is a query that asks for all items above a threshold. BM25 weights are divided by the item's
score for its own text, so the threshold is a share of the item that the passage must hold. The terms that are in
most items may together give an item at most half of the threshold (the choice of these terms guarantees that); so no
item can pass without enough of its other terms, and one numpy step finds the few passages for which some item can.
Those run block-max WAND, and what it retrieves is verified: word shingles of the item's question (all but its last
sentence), of its answer (the last sentence) and of both that the passage holds.

The window is twice the longest item, so an item that lies whole in a document lies whole in some passage. Items are
broadcast in shards of at most SHARD_BYTES; more items mean more passes over the documents, not a larger broadcast.

Defined results: a null or empty text or item matches nothing; items with equal text all match; repeated rows are
reported one by one; rows with a null doc_id are reported with it; empty tables give no rows; further columns are
ignored. An item with fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.textkit import Words, column_bytes, pieces, shingles, tidy

THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
SHARD_BYTES = 32 << 20
POSTINGS_BLOCK = 16
LEAKS = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double, overlap double"


def _hashes(texts: list) -> list:
    buf, off = column_bytes(pa.array(texts, pa.string()))
    words = Words(buf, off)
    hashes = words.hashes()
    return [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(hashes, np.array([0, len(hashes)]), k)[0]) if len(hashes) >= k else np.zeros(0, np.uint64)


def _asked(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Words in a shingle, and the shingles to look for; a shorter text is one shingle."""
    k = min(SHINGLE, max(1, len(hashes)))
    return k, _grams(hashes, k)


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one; one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Whole:
    """Of all items: how many there are, their mean and greatest length, and how many items hold each of the (sorted) terms."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


@dataclass
class Index:
    """Items as numbers; the postings of term k are items[at[k]:at[k+1]] with their weights."""

    ids: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    essential: np.ndarray
    common: np.ndarray  # what the other terms give each item
    question: list
    answer: list
    whole: list
    window: int

    @staticmethod
    def build(rows: list, threshold: float = THRESHOLD, whole: Whole | None = None) -> Index | None:
        """rows: (item_id, text); whole: the statistics of all items, if rows are a part of them."""
        words = _hashes([r[1] for r in rows])
        pairs = [(r, w) for r, w in zip(rows, words) if len(w)]
        if not pairs:
            return None
        rows, words = [list(x) for x in zip(*pairs)]
        length = np.array([len(w) for w in words], float)
        counted = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([t for t, _ in counted])
        item = np.repeat(np.arange(len(rows)), [len(t) for t, _ in counted])
        tf = np.concatenate([c for _, c in counted]).astype(float)
        terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        whole = whole or Whole(len(rows), length.mean(), int(length.max()), terms, df)
        every = whole.df[np.searchsorted(whole.terms, terms)]
        idf = np.log1p((whole.items - every + 0.5) / (every + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / whole.mean)[item]))
        weight /= np.bincount(item, weight, len(rows))[item]
        order = np.lexsort((item, term))
        at = np.searchsorted(term[order], np.arange(len(terms) + 1))
        items, weights = item[order], weight[order]
        essential, common = np.ones(len(terms), bool), np.zeros(len(rows))
        for k in np.argsort(-df, kind="stable"):
            own = slice(at[k], at[k + 1])
            if (common[items[own]] + weights[own] <= threshold / 2).all():
                common[items[own]] += weights[own]
                essential[k] = False
        halves = [question_and_answer(r[1]) for r in rows]
        grams = [[_asked(h) for h in _hashes([x[i] for x in halves])] for i in (0, 1)]
        return Index(np.array([r[0] for r in rows]), terms, at, items, weights, essential, common, *grams, [_asked(w) for w in words], max(64, 2 * whole.longest))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for other words."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def wand(self, terms: np.ndarray, threshold: float) -> list:
        """(item, score) of all items whose score for the distinct terms is at least the threshold: block-max WAND."""
        lists = []
        for t in terms:
            a, b = int(self.at[t]), int(self.at[t + 1])
            docs, weights = self.items[a:b], self.weights[a:b]
            blocks = range(0, b - a, POSTINGS_BLOCK)
            lists.append([0, docs.tolist(), weights.tolist(), [float(weights[i : i + POSTINGS_BLOCK].max()) for i in blocks], [int(docs[min(i + POSTINGS_BLOCK, b - a) - 1]) for i in blocks], float(weights.max())])
        out, slack = [], threshold - 1e-9
        seek = lambda x, doc: _seek(x[1], x[0], doc)
        while True:
            lists = sorted((x for x in lists if x[0] < len(x[1])), key=lambda x: x[1][x[0]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[5]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            doc = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == doc:
                pivot += 1
            bound, ends = 0.0, []
            for x in lists[: pivot + 1]:  # the blocks that would hold doc
                block = _seek(x[4], x[0] // POSTINGS_BLOCK, doc)
                if block < len(x[4]):
                    bound += x[3][block]
                    ends.append(x[4][block])
            if bound >= slack:
                if lists[0][1][lists[0][0]] == doc:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[2][x[0]]
                        x[0] += 1
                    if score >= slack:
                        out.append((doc, score))
                else:
                    for x in lists[: pivot + 1]:
                        x[0] = seek(x, doc)
            else:  # nothing before the first block's end can pass
                after = [x[1][x[0]] for x in lists[pivot + 1 : pivot + 2]]
                to = max(doc + 1, min([e + 1 for e in ends] + after))
                for x in lists[: pivot + 1]:
                    x[0] = seek(x, to)


def _seek(values: list, at: int, least: int) -> int:
    while at < len(values) and values[at] < least:
        at += 1
    return at


def _held(passage: np.ndarray, known: dict, k: int, grams: np.ndarray) -> float:
    """The share of grams that the passage holds; known: its own shingles, by their words."""
    if k not in known:
        known[k] = _grams(passage, k)
    return float(np.isin(grams, known[k], assume_unique=True).mean()) if len(grams) else 0.0


def _candidates(index: Index, terms: np.ndarray, half: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of half passages with which a passage begins that some item may pass. half: of each word; last: whether a
    half passage is its document's last."""
    own = np.flatnonzero(terms >= 0)
    own = own[index.essential[terms[own]]]
    if not len(own):
        return np.zeros(0, int)
    n_terms, n_items = len(index.terms), len(index.ids)
    pair = np.unique(half[own].astype(np.int64) * n_terms + terms[own])
    at, term = pair // n_terms, pair % n_terms
    each = index.at[term + 1] - index.at[term]
    posting = np.repeat(index.at[term] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    keys, where = np.unique(np.repeat(at, each) * n_items + index.items[posting], return_inverse=True)
    weight = np.bincount(where, index.weights[posting], len(keys))
    after = np.minimum(np.searchsorted(keys, keys + n_items), len(keys) - 1)
    here = keys // n_items
    total = weight + np.where((keys[after] == keys + n_items) & ~last[here], weight[after], 0)
    found = np.unique(here[total >= threshold - 1e-9 - index.common[keys % n_items]])
    before = found[found > 0] - 1  # an item may begin in the half before with words that are no essential terms
    return np.union1d(found, before[~last[before]])


def _best(index: Index, buf: np.ndarray, off: np.ndarray, threshold: float, overlap: float) -> dict:
    """(document, item): (overlap, score, passage, question overlap, answer overlap) at the best passage of some documents."""
    size, best = index.window // 2, {}
    words = Words(buf, off)
    hashes, doc = words.hashes(), words.doc()
    if not len(hashes):
        return best
    terms = index.lookup(hashes)
    halves = -(-np.diff(words.first) // size)
    begin = np.concatenate([[0], np.cumsum(halves)])
    within = (np.arange(len(hashes)) - words.first[doc]) // size
    last = np.zeros(begin[-1], bool)
    last[begin[1:][halves > 0] - 1] = True
    for h in _candidates(index, terms, begin[doc] + within, last, threshold):
        d = int(np.searchsorted(begin, h, "right") - 1)
        lo = int(words.first[d] + (h - begin[d]) * size)
        hi = min(lo + index.window, int(words.first[d + 1]))
        asked = np.unique(terms[lo:hi])
        found = index.wand(asked[asked >= 0], threshold)
        held: dict = {}
        for item, score in found:
            q, x, both = (_held(hashes[lo:hi], held, *part[item]) for part in (index.question, index.answer, index.whole))
            if both >= overlap or min(q, x) >= overlap:
                row = (both, score, lo - int(words.first[d]), q, x)
                best[d, item] = max(best.get((d, item), row), row)
    return best


def _scan(shared, threshold: float, overlap: float):
    @tidy
    def run(batches):
        index = shared.value
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            ids = batch.column(0)
            for a, b in pieces(off):
                best = _best(index, buf[off[a] : off[b]], off[a : b + 1] - off[a], threshold, overlap)
                if best:
                    keys, rows = list(best), list(best.values())
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([a + d for d, _ in keys])),
                            pa.array([int(index.ids[i]) for _, i in keys], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64()),
                            *(pa.array([r[k] for r in rows], pa.float64()) for k in (1, 3, 4, 0)),
                        ],
                        names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap", "overlap"],
                    )

    return run


def _terms(batches):
    """(item, term, words) for each distinct term of items (item, text), whose number of words is on each row."""
    for batch in batches:
        for key, words in zip(batch.column(0).to_pylist(), _hashes(batch.column(1).to_pylist())):
            own = np.unique(words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(own), pa.array(np.full(len(own), len(words)))], names=["part", "term", "words"])


def _indexes(items: DataFrame, threshold: float, shard_bytes: int):
    """The broadcast index of each shard of the items; their statistics are those of all items, so that a score is the
    same however many shards there are."""
    spark = items.sparkSession
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // (shard_bytes // 2)))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    terms = items.select("part", "text").mapInArrow(_terms, "part long, term long, words long") if shards > 1 else None
    if terms is not None:
        words = items.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).where("n > 0")
        n, mean, longest = words.agg(F.count("*"), F.avg("n"), F.max("n")).first()
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = items.where(F.col("part") == k).orderBy("item_id", "text").collect()
        whole = None
        if terms is not None and n:
            held = df.join(terms.where(F.col("part") == k).select("term").distinct(), "term", "left_semi").toArrow()
            order = np.argsort(key := held["term"].to_numpy().view(np.uint64))
            whole = Whole(n, mean, longest, key[order], held["df"].to_numpy()[order])
        index = Index.build([(r.item_id, r.text) for r in own], threshold, whole)
        if index is not None:
            yield spark.sparkContext.broadcast(index)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """LEAKS rows: each document (doc_id, text) with each item (item_id, text) that it holds, at its best passage."""
    out = None
    for index in _indexes(items, threshold, shard_bytes):
        found = docs.select("doc_id", "text").mapInArrow(_scan(index, threshold, overlap), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def leaked(text: Column, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> Column:
    """Whether a text holds any of the items (item_id, text); the row's other columns don't go to Python."""

    def flag(index) -> Column:
        @tidy
        def run(batches):
            for texts in batches:
                buf, off = column_bytes(texts)
                out = np.zeros(len(texts), bool)
                for a, b in pieces(off):
                    out[[a + d for d, _ in _best(index.value, buf[off[a] : off[b]], off[a : b + 1] - off[a], threshold, overlap)]] = True
                yield pa.array(out)

        def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(texts)

        return F.arrow_udf(found, "boolean").asNondeterministic()(F.coalesce(text, F.lit("")))

    return functools.reduce(Column.__or__, map(flag, _indexes(items, threshold, shard_bytes)), F.lit(False))


def op6_decontaminate_wand(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
