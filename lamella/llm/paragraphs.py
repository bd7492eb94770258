"""Operator 1, substring dedup by paragraphs: MinHash banding, exact Jaccard, components, common runs.

A paragraph is a window of SIZE words that starts at an anchor. Anchors are content-defined: a word at which the hash of
the SHINGLE words from it on is the least one of some SPAN consecutive ones. Two documents that share RUN_WORDS words
verbatim, wherever these lie in their lines, have all SPAN hashes of a window in common, so its anchor, and with it a
whole paragraph (SPAN + SIZE - 1 <= RUN_WORDS).

Paragraphs with equal shingle sets are one class. Classes that agree in one of BANDS bands of ROWS MinHash values meet
(of pairs with a Jaccard similarity of 0.8, 98 in 100; equal ones always), full sets confirm each link, and links are
closed to clusters. Those of one document that overlap are compared at once, where the document is read, as ordinary
texts have many of them and need no bucket then; a bucket that several texts share holds all that have its key. A cluster counts if it spans documents. Paragraphs of such clusters form a chain while no more words
lie between them than an anchor may skip; a near copy whose words are changed here and there stays one chain.

A chain's ends are grown to the common run: of windows of PROBE words around its first and last paragraph, and around
each paragraph of a chain under RUN_WORDS (and all others in their clusters), those count that another document has,
too. So a run of RUN_WORDS words is
always found, its ends are exact to STEP - 1 words, and of chains under RUN_WORDS only those stay that hold a common run
of PROBE words: repeated headings and license lines are left alone.

Defined results: a null or empty text has no paragraph, and neither has one under RUN_WORDS words; the occurrence with
the least (doc_id, start) of a cluster stays, as do those that overlap it, all others are removed; equal neighbours in a
text that repeats itself are one occurrence; repeated rows repeat their paragraphs, which count
as of one document if doc_id is the same, as do different texts under one doc_id; rows with a null doc_id are left out;
an empty table gives no rows; further columns are ignored. A passage that a single document repeats is left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.neardup import bucket_components
from lamella.llm.textkit import Words, column_bytes, mix64, pieces, powers, tidy
from lamella.workspace import Workspace

SHINGLE, SIZE, SPAN, RUN_WORDS, PERCENT = 5, 20, 31, 50, 80
GRAMS = SIZE - SHINGLE + 1
PROBE, STEP = 45, 5
BANDS, ROWS = 4, 2
KEYS = [f"k{i}" for i in range(BANDS)]
_seed = np.random.default_rng(1)
_WORD = _seed.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _seed.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _seed.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BASE = int(_seed.integers(1 << 61, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of width values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


class Paragraphs:
    """The paragraphs of some documents: doc, pos (first word's number in its document), last (that of the last of equal
    neighbours), and their shingles."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        words = Words(buf, off)
        self.words, self.hashes = words, words.hashes()
        self.doc = self.pos = self.last = self.at = self.every = np.zeros(0, np.int64)
        n = len(self.hashes) - SHINGLE + 1  # shingles, those over a document's end among them
        self.grams = np.zeros(0, np.uint64)
        if n < SPAN:
            return
        grams = self.hashes[:n] * _WORD[0]
        for j in range(1, SHINGLE):
            grams += self.hashes[j : n + j] * _WORD[j]
        self.grams = grams = mix64(grams)
        doc = words.doc()
        whole = doc[: n - SPAN + 1] == doc[SPAN + SHINGLE - 2 :]  # windows inside a document
        least = np.where(whole, _sliding(np.minimum, grams, SPAN), np.uint64(0))
        pad = np.zeros(SPAN - 1, np.uint64)
        anchor = _sliding(np.maximum, np.concatenate([pad, least, pad]), SPAN) == grams
        at = np.flatnonzero(anchor)
        at = at[at + SIZE <= words.first[doc[at] + 1]]
        self.every = self.at = at
        if len(at) > 1:  # a text that repeats itself has one anchor after the other: equal neighbours are one paragraph
            same = (doc[at[1:]] == doc[at[:-1]]) & (grams[at[1:]] == grams[at[:-1]])
            same &= self._sums(at[1:]) == self._sums(at[:-1])
            self.at = at[np.concatenate([[True], ~same])]
            at = at[np.concatenate([~same, [True]])]
        self.doc = doc[self.at]
        self.pos, self.last = self.at - words.first[self.doc], at - words.first[self.doc]

    def sets(self) -> np.ndarray:
        """paragraphs x GRAMS shingle hashes."""
        return self.grams[self.at[:, None] + np.arange(GRAMS)[None, :]]

    def _sums(self, at: np.ndarray) -> np.ndarray:
        return mix64(self.grams[at[:, None] + np.arange(GRAMS)[None, :]]).sum(1, dtype=np.uint64)

    def names(self) -> np.ndarray:
        """A hash of each paragraph's shingles."""
        return mix64(self._sums(self.at)).view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """paragraphs x BANDS band keys, and for each paragraph the bits of those under which it counts for its document's
        bucket: of paragraphs that all overlap each other the first one, as links() has theirs, and else all."""
        low = (self.sets() >> np.uint64(32)).astype(np.uint32)
        keys, fresh = np.zeros((len(low), BANDS), np.uint64), np.zeros(len(low), np.int32)
        for band in range(BANDS):
            for r in range(band * ROWS, band * ROWS + ROWS):
                least = ((low ^ _FLIP[r]) * _MULTIPLY[r]).min(1) if len(low) else np.zeros(0, np.uint32)
                keys[:, band] = keys[:, band] << np.uint64(32) | least
            keys[:, band] = mix64(keys[:, band] + np.uint64(band * 0x9E3779B97F4A7C15 % (1 << 64)))
            order = np.lexsort((self.at, keys[:, band], self.doc))
            new = np.ones(len(order), bool)
            new[1:] = (keys[order[1:], band] != keys[order[:-1], band]) | (self.doc[order[1:]] != self.doc[order[:-1]])
            group, at = np.cumsum(new) - 1, self.at[order]
            wide = at[np.append(new[1:], True)[: len(at)]] - at[new] >= SIZE
            fresh[order[new | wide[group]]] |= 1 << band
        return keys.view(np.int64), fresh

    def links(self, keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of overlapping paragraphs that agree in a band and whose sets are similar."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, SIZE):
            i = np.flatnonzero((self.at[step:] - self.at[:-step] < SIZE) & (self.doc[step:] == self.doc[:-step]))
            if not len(i):
                break
            i = i[(keys[i] == keys[i + step]).any(1)]
            left.append(i)
            right.append(i + step)
        left, right = np.concatenate(left), np.concatenate(right)
        sets = np.sort(self.sets(), axis=1)
        size = 1 + np.count_nonzero(sets[:, 1:] != sets[:, :-1], axis=1)
        both = np.sort(np.concatenate([sets[left], sets[right]], axis=1), axis=1)
        union = 1 + np.count_nonzero(both[:, 1:] != both[:, :-1], axis=1)
        near = 100 * (size[left] + size[right] - union) >= percent * union
        return left[near], right[near]

    def probes(self, doc: np.ndarray, pos: np.ndarray, last: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the asked, first word, hash) of the windows of PROBE words around asked paragraphs, pos to last of equal
        neighbours, STEP words apart; of equal windows of one chain the first and the last one."""
        n = len(self.hashes)
        if not n or not len(doc):
            return (np.zeros(0, np.int64),) * 3
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(self.hashes) * powers(_BASE, n), out=total[1:])
        a, b = (np.searchsorted(self.every, self.words.first[doc] + x, side) for x, side in ((pos, "left"), (last, "right")))
        b = np.maximum(a, b)
        asked = np.repeat(np.arange(len(doc)), b - a)
        begin = self.every[np.arange(len(asked)) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)]
        start = begin[:, None] - np.arange(0, PROBE - SIZE + STEP, STEP)[None, :]
        fits = (start >= self.words.first[doc[asked]][:, None]) & (start + PROBE <= self.words.first[doc[asked] + 1][:, None])
        who = asked[np.nonzero(fits)[0]]
        start = start[fits]
        value = mix64((total[start + PROBE] - total[start]) * powers(_INVERSE, n)[start]).view(np.int64)
        order = np.lexsort((start, value, chain[who], doc[who]))
        x, y = order[1:], order[:-1]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (value[x] != value[y]) | (chain[who[x]] != chain[who[y]]) | (doc[who[x]] != doc[who[y]])
        order = order[new[:-1] | new[1:]]
        who, start, value = who[order], start[order], value[order]
        return who, start - self.words.first[doc[who]], value


def _each(batch, column: int):
    buf, off = column_bytes(batch.column(column))
    for a, b in pieces(off):
        yield a, b, Paragraphs(buf[off[a] : off[b]], off[a : b + 1] - off[a])


def _classed(percent: int):
    """Paragraphs, and their links inside a document: (h of the pair, k0 and k1 of its sides), without further keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, found in _each(batch, 1):
                if not len(found.doc):
                    continue
                keys, fresh = found.keys()
                names = found.names()
                left, right = found.links(keys, percent)
                own, n = np.concatenate([np.arange(len(names)), left]), len(names)
                pair = np.sort(np.stack([names[left], names[right]], axis=1), axis=1)
                pair_name = mix64(pair[:, 0].view(np.uint64) * _WORD[0] + pair[:, 1].view(np.uint64) * _WORD[1]).view(np.int64)
                rows = [np.concatenate([keys, np.pad(pair, ((0, 0), (0, BANDS - 2)))])[:, k] for k in range(BANDS)]
                columns = [pa.array(x, mask=(np.arange(len(own)) >= n) if k > 1 else None) for k, x in enumerate(rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][found.doc[own]]), pa.array(found.pos[own].astype(np.int32)), pa.array(np.concatenate([names, pair_name])), *columns, pa.array(np.pad(fresh, (0, len(left))))],
                    names=["doc_id", "pos", "h", *KEYS, "fresh"],
                )

    return tidy(run)


@tidy
def _placed(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, found in _each(batch, 1):
            if len(found.doc):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][found.doc]), pa.array(found.pos.astype(np.int32)), pa.array(found.last.astype(np.int32)), pa.array(found.names())], names=["doc_id", "pos", "last", "h"])


def _asked(batch, a: int, b: int, column: int):
    """Of rows a to b the number of each asked struct's row, and the structs."""
    lists = batch.column(column).slice(a, b - a)
    return np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy())), lists.flatten()


@tidy
def _wanted(batches):
    """(id, members) of the paragraphs asked for: rows (text, wanted array<struct<pos, id>>); another text of the same
    doc_id may have no such paragraph, or another one there."""
    for batch in batches:
        for a, b, found in _each(batch, 0):
            row, asked = _asked(batch, a, b, 1)
            if not len(found.doc) or not len(row):
                continue
            key = found.doc * (1 << 40) + found.pos
            want = row * (1 << 40) + asked.field("pos").to_numpy()
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero((key[at] == want) & (found.names()[at] == asked.field("id").to_numpy()))
            sets = np.sort(found.sets()[at[hit]], axis=1)
            yield pa.RecordBatch.from_arrays([asked.field("id").take(pa.array(hit)), pa.array([np.unique(x).tobytes() for x in sets], pa.binary())], names=["id", "members"])


@tidy
def _probed(batches):
    """(doc_id, chain, start, window) for rows (doc_id, text, asked array<struct<pos, last, chain>>)."""
    for batch in batches:
        for a, b, found in _each(batch, 1):
            row, asked = _asked(batch, a, b, 2)
            who, start, window = found.probes(row, *(asked.field(c).to_numpy().astype(np.int64) for c in ("pos", "last", "chain")))
            ids = batch.column(0).slice(a, b - a).take(pa.array(row[who]))
            yield pa.RecordBatch.from_arrays([ids, asked.field("chain").take(pa.array(who)), pa.array(start.astype(np.int32)), pa.array(window)], names=["doc_id", "chain", "start", "window"])


def repeated_passages(docs: DataFrame, percent: int = PERCENT, work: Workspace | None = None) -> DataFrame:
    """doc_id, start, words, cluster, first_doc_id, first_start, removed: the passages, in words, that docs (doc_id, text)
    have in common. cluster, first_doc_id and first_start are of the passage's first paragraph; a passage some of whose
    paragraphs stay and some go is reported in parts."""
    work = work or Workspace(docs.sparkSession, "paragraphs")
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = docs.mapInArrow(_classed(percent), "doc_id long, pos int, h long, " + ", ".join(f"{k} long" for k in KEYS) + ", fresh int")
    classes = found.groupBy("h").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), *(F.max(k).alias(k) for k in KEYS), F.bit_or("fresh").alias("fresh"), F.count("*").alias("rows")
    )
    named = work.save(classes.select(F.col("h").alias("id"), "first.doc_id", "first.pos", "last", *KEYS, "fresh", (F.col("rows") > 1).alias("again")), "classes")
    classes, inside = named.where(f"{KEYS[-1]} IS NOT NULL"), named.where(f"{KEYS[-1]} IS NULL").select(F.col("k0").alias("a"), F.col("k1").alias("b"))
    work.tidy()

    def sets_of(ids: DataFrame) -> DataFrame:
        where = classes.select("id", "doc_id", "pos").join(ids, "id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "id")).alias("wanted"))
        where = work.save(where, "where")
        return work.save(docs.join(where.hint("merge"), "doc_id").select("text", "wanted").mapInArrow(_wanted, "id long, members binary").dropDuplicates(["id"]), "sets")

    # a key of one document alone needs no bucket: fresh ones number the documents that have it
    own = [F.when(F.col("fresh").bitwiseAND(1 << i) != 0, F.when(F.col("again"), 2).otherwise(1)).otherwise(0) for i in range(BANDS)]
    members = classes.select("id", F.inline(F.array(*(F.struct(F.col(k).alias("key"), n.alias("texts")) for k, n in zip(KEYS, own)))))
    tied = bucket_components(members, None, sets_of, percent, work, classes.select("id", *KEYS), inside)
    work.tidy()
    all_classes, classes = named, classes.join(tied.withColumnRenamed("node", "id"), "id", "left")
    named = work.save(classes.select(F.col("id").alias("h"), "doc_id", "pos", "last", F.coalesce("component", "id").alias("cluster")), "named")
    work.drop(all_classes)
    clusters = named.groupBy("cluster").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("last").alias("last")).where("first.doc_id < last")
    clusters = work.save(clusters.select("cluster", F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_start")), "clusters")
    repeated = work.save(named.select("h", "cluster").join(clusters, "cluster"), "repeated")
    hits = work.save(docs.mapInArrow(_placed, "doc_id long, pos int, last int, h long").join(repeated, "h").drop("h"), "hits")
    work.drop(named)
    work.tidy()

    order = Window.partitionBy("doc_id").orderBy("pos", "cluster")
    gap = F.col("pos") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) > SPAN
    removed = (F.col("doc_id") != F.col("first_doc_id")) | (F.col("pos") >= F.col("first_start") + SIZE)
    hits = hits.withColumn("removed", removed)
    turn = F.coalesce(F.lag("removed").over(order) != F.col("removed"), F.lit(False))
    hits = hits.withColumns({"chain": F.sum(F.coalesce(gap, F.lit(True)).cast("long")).over(order), "part": F.sum(turn.cast("long")).over(order)})
    hits = work.save(hits, "chained")
    chains = hits.groupBy("doc_id", "chain").agg(F.min("pos").alias("head"), F.max("last").alias("tail"), (F.max("pos") + SIZE - F.min("pos") >= RUN_WORDS).alias("long"))
    chains = work.save(chains, "chains")
    # what is asked of one occurrence of a paragraph is asked of all, as a window counts only if another document has it
    at_end = ~F.col("long") | (F.col("pos") == F.col("head")) | (F.col("last") == F.col("tail"))
    wanted = work.save(hits.join(chains, ["doc_id", "chain"]).where(at_end).select("cluster").distinct(), "wanted")
    asked = hits.join(wanted, "cluster", "left_semi").select("doc_id", "pos", "last", "chain").distinct()
    asked = work.save(asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last", "chain")).alias("asked")), "asked")
    probes = work.save(docs.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asked").mapInArrow(_probed, "doc_id long, chain long, start int, window long"), "probes")
    shared = work.save(probes.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window"), "shared")
    grown = probes.join(shared, "window").groupBy("doc_id", "chain").agg(F.min("start").alias("begin"), F.max(F.col("start") + PROBE).alias("end"))
    chains = chains.join(grown, ["doc_id", "chain"], "left").where("long OR begin IS NOT NULL")
    chains = work.save(chains.select("doc_id", "chain", "head", "tail", F.least("head", "begin").alias("begin"), F.greatest(F.col("tail") + SIZE, "end").alias("end")), "grown")
    parts = hits.groupBy("doc_id", "chain", "part").agg(
        F.min("pos").alias("from"), F.max("last").alias("to"), F.first("removed").alias("removed"), F.min(F.struct("pos", "cluster", "first_doc_id", "first_start")).alias("first")
    )
    parts = parts.join(chains, ["doc_id", "chain"])
    start = F.when(F.col("from") == F.col("head"), F.col("begin")).otherwise(F.col("from")).cast("long")
    end = F.when(F.col("to") == F.col("tail"), F.col("end")).otherwise(F.col("to") + SIZE)
    first = [F.col(f"first.{c}").alias(c) for c in ("cluster", "first_doc_id", "first_start")]
    return parts.select("doc_id", start.alias("start"), (end - start).cast("long").alias("words"), *first, "removed")


def op1_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
