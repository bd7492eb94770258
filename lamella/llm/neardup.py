"""Operator 2, near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's signature has 60 symbols of 16 bits (b-bit minwise hashes of its set of word shingles). It is split into
12 chunks of 5 symbols. By the pigeonhole principle two signatures that differ in at most 23 symbols have a chunk in
which they differ in at most one; so each chunk is indexed five times, each time with another symbol left out, and
every pair within that distance meets in a bucket. Sets with a Jaccard similarity of 0.85 differ in 9 symbols on
average, and in more than 23 with a probability of about 1e-6.

Equal sets are one class first. A bucket's members are compared with its most central one, and then all those still in
different components with each other; pairs already connected, or too different in any case, need no look (see
bucket_components). Pairs within the signature distance are confirmed on the full sets, and links are closed to
components.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text with fewer words
than a shingle is one shingle; repeated rows stay and share a class; a row with a null doc_id keeps a null component
and is not kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import graph
from lamella.llm.textkit import Words, column_bytes, distinct_sets, mix64, pieces, shingles, tidy
from lamella.workspace import Workspace

CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
#: floor(DISTANCE / CHUNKS) = 1 error in some chunk at most.
DISTANCE = 2 * CHUNKS - 1
PERCENT = 85
_seed = np.random.default_rng(2)
_MULTIPLY = _seed.integers(1, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _seed.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_KEY = _seed.integers(1, 1 << 63, (SYMBOLS, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(values: np.ndarray, off: np.ndarray, n: int = SYMBOLS) -> np.ndarray:
    """documents x n least hash values (uint32) of non-empty sets."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((low ^ _FLIP[k % SYMBOLS]) * _MULTIPLY[k % SYMBOLS], off[:-1])
    return out


def set_hash(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each non-empty set."""
    return np.add.reduceat(values, off[:-1]).view(np.int64), np.add.reduceat(mix64(values ^ np.uint64(0x9E3779B97F4A7C15)), off[:-1]).view(np.int64)


def _document_sets(batch, column: int, k: int = 5):
    """(first, last document, values, offsets) of the documents' shingle sets."""
    buf, off = column_bytes(batch.column(column))
    for a, b in pieces(off):
        words = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, *distinct_sets(*shingles(words.hashes(), words.first, k), b - a)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"


def _sign(batches):
    for batch in batches:
        for a, b, values, off in _document_sets(batch, 1):
            n = np.diff(off)
            has = np.flatnonzero(n)
            h1, h2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
            sig = np.zeros((b - a, SYMBOLS), np.uint16)
            if len(has):
                own = np.append(off[has], off[-1])
                h1[has], h2[has] = set_hash(values, own)
                sig[has] = (minhash(values, own) * np.uint32(0x9E3779B1)) >> np.uint32(16)
            lanes = sig.view(np.int64).ravel()
            per = SYMBOLS // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * per), pa.array(lanes))],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )


def _index(batches):
    """(key, id) for each chunk and each symbol left out."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lists = batch.column(1)
        sig = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(n, CHUNKS, CHUNK).astype(np.uint64)
        keys = np.empty((n, SYMBOLS), np.uint64)
        for c in range(CHUNKS):
            for out in range(CHUNK):
                at = c * CHUNK + out
                keys[:, at] = mix64(sum(sig[:, c, j] * _KEY[at, j] for j in range(CHUNK) if j != out) + _KEY[at, out])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS))], names=["key", "id"])


def distance(a: Column, b: Column, lanes: int = SYMBOLS // 4) -> Column:
    """Symbols in which two signatures differ: of each 16-bit lane, whether any bit does."""
    total = F.lit(0)
    for k in range(lanes):
        x = a[k].bitwiseXOR(b[k])
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _sets(batches):
    for batch in batches:
        for a, b, values, off in _document_sets(batch, 1):
            raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off * 8), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), raw.cast(pa.binary())], names=["id", "members"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets, saved (id, members), are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(_confirm(percent)), "a long, b long")


#: 64-bit words of a set's bitmap.
BITMAP = 32
_BITS = [f"w{k}" for k in range(BITMAP)]


def _bitmaps(batches):
    """For each set its size, how many of its values share a bit with another one, and the bitmap of hashed values."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        size = np.array([len(v) for v in values])
        bits = np.zeros((n, BITMAP * 64), np.uint8)
        bits[np.repeat(np.arange(n), size), (mix64(np.concatenate(values)) >> np.uint64(40)) % np.uint64(BITMAP * 64)] = 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(size - bits.sum(1, dtype=np.int64)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(BITMAP))], names=["id", "n", "lost", *_BITS])


def bucket_components(members: DataFrame, close, sets_of, percent: int, work: Workspace, keys: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of ids that share a key of members (key, id) and whose sets are similar; see components().

    close(pairs (a, b)), if not None, may drop pairs that can't be similar; sets_of(ids (id)) gives saved (id, members).
    keys, if given, has all keys of an id in columns (id, k0, k1, ...); a pair then meets at its first common key only.
    known, if given, has links (a, b) that hold already. If members has a column texts (see shared_buckets()), these have
    to hold all links that only keys of one text would give.

    Each bucket is compared with one member at first: the one that meets most others in all its buckets, which is the
    original where the others are its copies. Then all pairs of a bucket that are still of different components are
    compared, whatever their number; pairs of one component need no look. Of these, only the pairs go on whose sets can
    be similar: an intersection is no larger than what the sets' bitmaps have in common, plus the values that a bitmap
    lost to collisions. That tells apart the many copies of one text that are too far from each other."""
    buckets = graph.shared_buckets(members, work)
    ids = work.save(buckets.select("id").distinct(), "ids")
    sets = sets_of(ids)
    weight = work.save(buckets.groupBy("id").agg(F.sum("size").alias("weight")), "weight")
    members = work.save(buckets.join(weight, "id").select("key", "id", "weight"), "members")
    work.drop(buckets, ids, weight)
    work.tidy()

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = work.save(pairs.select(F.greatest("id", "stray").alias("a"), F.least("id", "stray").alias("b")).distinct(), "pairs")
        near = work.save(close(pairs), "close") if close else pairs
        out = work.save(confirm(near, sets, percent), "links")
        work.drop(pairs, near if close else None)
        return out

    first = work.save(members.groupBy("key").agg(F.max_by("id", "weight").alias("stray")), "first")
    links = linked(members.join(first, "key").where("id <> stray"))
    found = graph.components(links if known is None else links.unionByName(known), work)
    now = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    now = work.save(now, "now")
    work.drop(first, links, members)
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", "size").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    main = work.save(main.select("key", "main"), "main")
    several = work.save(now.join(main, "key"), "open")
    work.drop(now, main)
    work.tidy()
    shape = "id long, n long, lost long, " + ", ".join(f"{w} long" for w in _BITS)
    facts = sets.join(several.select("id").distinct(), "id", "left_semi").mapInArrow(tidy(_bitmaps), shape)
    named = [] if keys is None else [c for c in keys.columns if c != "id"]
    if named:
        facts = facts.join(keys, "id")
    facts = work.save(facts, "facts")
    open_ = work.save(several.join(facts, "id"), "open")
    work.drop(several, facts)
    renamed = {"id": "stray", "component": "own", "n": "stray_n", "lost": "stray_lost"} | {c: f"s_{c}" for c in [*_BITS, *named]}
    strays = work.save(open_.where("component <> main").drop("main").withColumnsRenamed(renamed), "strays")
    common = " + ".join(f"bit_count({w} & s_{w})" for w in _BITS)
    alike = f"(least(lost, stray_lost) + {common}) * {100 + percent} >= {percent} * (n + stray_n)"
    cross = open_.join(strays, "key").where("own <> component AND (component = main OR stray < id)").where(alike)
    if named:
        cross = cross.where("key = CASE " + " ".join(f"WHEN {c} = s_{c} THEN {c}" for c in named) + " END")
    more = linked(cross)
    if more.limit(1).count():  # the stars found so far stand for the links that made them
        found = graph.components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), work)
    work.drop(sets, open_, strays, more)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs (doc_id, text)."""
    work = work or Workspace(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text")
    signed = work.save(docs.mapInArrow(tidy(_sign), SIGNED), "signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2")
    classes = work.save(classes.agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    # smaller sets are similar enough only if they are equal
    least = next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))
    signs = classes.where(F.col("n_shingles") >= least).select("id", "sig")

    def close(pairs: DataFrame) -> DataFrame:
        left, right = (signs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        return pairs.join(left, "a").join(right, "b").where(distance(F.col("sig_a"), F.col("sig_b")) <= DISTANCE).select("a", "b")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = ids.withColumnRenamed("id", "doc_id")
        return work.save(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(_sets), "id long, members binary"), "sets")

    found = bucket_components(signs.select("id", "sig").mapInArrow(tidy(_index), "key long, id long"), close, sets_of, percent, work)
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left")
    named = work.save(named.select("n_shingles", "h1", "h2", F.coalesce("component", "id").alias("component")), "named")
    work.drop(classes)
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["n_shingles", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op2_neardup_multi_index(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
