"""Operator 10, near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are one class. Cluster centres are fitted on a bounded sample (SAMPLE vectors); every vector is a member
of the shards of its OVERLAP nearest centres. Each shard builds its graph by robust pruning (an edge to a neighbour is
dropped if an earlier, nearer neighbour is nearer still to it by the factor ALPHA), and the adjacency lists that a
vector got in several shards are united; a few random edges keep islands of near copies reachable. Then every vector
is a query in the shards of its PROBES nearest centres: a greedy search with a beam starts at the shard's medoid, and
from all nodes within the range (and a little beyond) the search goes on expanding until no new one appears. Hits are
verified in double precision. A partner that is a member of several of a query's shards counts in the nearest of them
only; links are closed inside each task first and then between tasks.

A shard with more than MEMBERS vectors is split by a hash into pieces, and each of its queries goes to all of them; so
no task holds an unbounded group and no vector is left out. `audit` compares a bounded sample of queries with all
vectors; while it finds a recall under LEAST_RECALL (the mean of the queries' shares of distinct partners), the beam and
the probes are doubled and the search is repeated, at last in all shards and with a beam as wide as a shard; a recall
that is under FAILED even then is an error. Vectors of each length are searched among themselves, one length at a time.

Defined results: a vector that is null, zero, or with null or non-finite components links with nothing, and neither do
vectors of different lengths; components whose squares a double can't hold are no obstacle; equal vectors link with each other; repeated ids are rows of one id; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import graph
from lamella.workspace import Workspace

LEAST_COSINE = 0.95
SAMPLE, SHARD, MEMBERS, QUERIES = 8192, 1000, 4096, 4096
OVERLAP, PROBES = 2, 3
DEGREE, CANDIDATES, NEAREST, ALPHA = 16, 40, 20, 1.2
RANDOM, BEAM, MARGIN, BLOCK = 2, 16, 0.04, 512
AUDIT, LEAST_RECALL, FAILED = 256, 0.97, 0.9


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 10) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(size > 0, total / np.where(size > 0, size, 1), out)
    return out


def robust_prune(vectors: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list:
    """Neighbour numbers of each unit vector, by distance 2 - 2 cos; neighbours are mutual."""
    n = len(vectors)
    if n < 2:
        return [np.zeros(0, int) for _ in range(n)]
    k, out, close = min(candidates, n - 1), [[] for _ in range(n)], []
    for a in range(0, n, 512):
        near = vectors[a : a + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(near, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        top, gap = np.take_along_axis(top, order, 1), 2 - 2 * np.take_along_axis(sims, order, 1)
        among = 2 - 2 * np.einsum("ikd,ild->ikl", vectors[top], vectors[top])
        alive, chosen = np.ones(top.shape, bool), np.zeros(top.shape, bool)
        for c in range(k):  # all vectors of the block at once, candidates from near to far
            take = alive[:, c] & (chosen.sum(1) < degree)
            chosen[take, c] = True
            alive &= ~(take[:, None] & (alpha * among[:, c] <= gap))
        close.append(top[:, :NEAREST])
        for i in range(len(near)):
            out[a + i] = top[i][chosen[i]].tolist()
    rng = np.random.default_rng(n)
    back: list = [[] for _ in range(n)]
    for ring in (rng.permutation(n) for _ in range(RANDOM)):
        for i, j in zip(ring, np.roll(ring, 1)):
            back[i].append(j), back[j].append(i)
    for i, mine in enumerate(out):
        for j in mine:
            if len(back[j]) < degree:
                back[j].append(i)
    for i, mine in enumerate(np.concatenate(close).tolist()):  # every vector is reached from two near ones, not only from hubs
        for j in sorted(mine, key=lambda j: len(back[j]))[:2]:
            back[j].append(i)
    return [np.array(sorted({*mine, *back[i]} - {i}), int) for i, mine in enumerate(out)]


class Search:
    """Range-expanding greedy search in one graph; for blocks of queries at once, in single precision."""

    def __init__(self, vectors: np.ndarray, neighbours: list, start: int, beam: int):
        self.exact, self.vectors, self.start, self.beam = vectors, vectors.astype(np.float32), start, beam
        width = max([1, *map(len, neighbours)])
        self.near = np.full((len(vectors), width), -1, np.int32)
        for i, mine in enumerate(neighbours):
            self.near[i, : len(mine)] = mine

    def ranged(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) numbers with a cosine of at least `least`, verified in double precision."""
        single = queries.astype(np.float32)
        q, n, beam = len(queries), len(self.vectors), self.beam
        seen = np.zeros((q, n), bool)
        seen[:, self.start] = True
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -3, np.float32)
        done = np.ones((q, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.start, single @ self.vectors[self.start], False
        floor = np.float32(least - MARGIN)
        first = np.flatnonzero(sims[:, 0] >= floor)
        hits = [(first, np.full(len(first), self.start))]
        active = np.arange(q)
        while len(active):
            at = np.where(done[active], np.float32(-9), sims[active]).argmax(1)
            node = ids[active, at]
            done[active, at] = True
            near = self.near[node]
            got = np.einsum("id,ikd->ik", single[active], self.vectors[near])
            got[(near < 0) | seen[active[:, None], near]] = -3
            seen[active[:, None], np.where(near < 0, self.start, near)] = True
            rows, cols = np.nonzero(got >= floor)
            hits.append((active[rows], near[rows, cols]))
            all_sims = np.concatenate([sims[active], got], 1)
            all_ids = np.concatenate([ids[active], near], 1)
            all_done = np.concatenate([done[active], got == -3], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, all_done))
            active = active[~done[active].all(1)]
        front = tuple(np.concatenate(x) for x in zip(*hits))
        found = [front]
        while len(front[0]):  # from everything in range, until nothing new is
            near = self.near[front[1]]
            owner = np.repeat(front[0], near.shape[1])
            near = near.ravel()
            ok = (near >= 0) & ~seen[owner, near]
            pair = np.unique(owner[ok].astype(np.int64) * n + near[ok])
            owner, near = pair // n, pair % n
            seen[owner, near] = True
            wide = self._cosines(single, self.vectors, owner, near) >= floor
            front = owner[wide], near[wide]
            found.append(front)
        who, what = (np.concatenate(x) for x in zip(*found))
        real = self._cosines(queries, self.exact, who, what) >= least
        return who[real], what[real]

    @staticmethod
    def _cosines(x: np.ndarray, y: np.ndarray, who: np.ndarray, what: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        out = np.empty(len(who), x.dtype)
        for a in range(0, len(who), step):
            out[a : a + step] = np.einsum("ij,ij->i", x[who[a : a + step]], y[what[a : a + step]])
        return out


def _unit(rows: pd.Series, width: int) -> np.ndarray:
    out = np.stack([np.asarray(x, np.float64) for x in rows]) if len(rows) else np.zeros((0, width))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _route(centre, n: int, pieces, blocks):
    """ROUTED rows: members of their OVERLAP nearest shards and, if n is greater, queries in their n nearest ones."""

    def run(batches):
        mid, split, queries = centre.value, pieces.value, blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            width = mid.shape[1]
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ mid.T
            k = min(n, len(mid))
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
            salt = batch.column(3).to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * k), pa.array(top.astype(np.int32).ravel()))
            row, rank, shard, piece, part, member = [], [], [], [], [], []
            for r in range(k):
                own = top[:, r]
                n_pieces, n_parts = split[own], queries[own]
                mine, block = salt % n_pieces, (salt // 65536) % n_parts
                each = n_pieces if n > OVERLAP else np.zeros(len(own), int)  # as a query: to every piece, in its part
                at = np.repeat(np.arange(len(own)), each)
                row.append(at), rank.append(np.full(len(at), r)), shard.append(own[at]), part.append(block[at]), member.append(np.zeros(len(at), bool))
                piece.append(np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each))
                if r < OVERLAP:  # as a member: in its piece, for every part
                    each = n_parts if n > OVERLAP else np.ones(len(own), int)
                    at = np.repeat(np.arange(len(own)), each)
                    row.append(at), rank.append(np.full(len(at), r)), shard.append(own[at]), piece.append(mine[at]), member.append(np.ones(len(at), bool))
                    part.append(np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t))
            at = cat(row, np.int64)
            for a in range(0, len(at), 20_000):
                cut = slice(a, a + 20_000)
                own = at[cut]
                yield pa.RecordBatch.from_arrays(
                    [cat(shard, np.int32)[cut], cat(piece, np.int32)[cut], cat(part, np.int32)[cut], *(batch.column(i).take(own) for i in (0, 1, 2, 4)), cat(rank, np.int32)[cut], pa.array(np.concatenate(member))[cut], lists.take(own)],
                    names=["shard", "piece", "part", "id", "copies", "embedding", "nbrs", "rank", "member", "nearest"],
                )

    return run


ROUTED = "shard int, piece int, part int, id long, copies long, embedding array<double>, nbrs array<long>, rank int, member boolean, nearest array<int>"


def _build(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        near = robust_prune(_unit(rows["embedding"], width))
        return pd.DataFrame({"id": ids, "nbrs": [ids[x].tolist() for x in near]})

    return run


def _search(centre, width: int, least: float, beam: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        member, query = rows[rows["member"]].sort_values("id"), rows[~rows["member"]].sort_values("id")
        ids, own = member["id"].to_numpy(), query["id"].to_numpy()
        links, pairs, root = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), own.copy()
        if len(ids) and len(own):
            x, y = _unit(member["embedding"], width), _unit(query["embedding"], width)
            near = []
            for mine in member["nbrs"]:
                mine = np.asarray(mine, np.int64)
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                near.append(at[ids[at] == mine])
            medoid = int((x @ centre.value[int(rows["shard"].iat[0])]).argmax())
            search = Search(x, near, medoid, beam)
            copies, rank = member["copies"].to_numpy(), query["rank"].to_numpy()
            homes = np.stack([np.asarray(h)[:OVERLAP] for h in member["nearest"]])
            nearer = np.stack([np.asarray(h) for h in query["nearest"]])
            nearer[np.arange(nearer.shape[1])[None, :] >= rank[:, None]] = -1  # the query's shards before this one
            parent = {}

            def find(k):
                while parent.setdefault(k, k) != k:
                    parent[k] = k = parent[parent[k]]
                return k

            for a in range(0, len(own), BLOCK):
                who, what = search.ranged(y[a : a + BLOCK], least)
                other = ids[what] != own[a + who]
                who, what = who[other], what[other]
                here = ~(homes[what][:, :, None] == nearer[a + who][:, None, :]).any((1, 2))
                links[a : a + BLOCK] += np.bincount(who, copies[what] * here, min(BLOCK, len(own) - a)).astype(np.int64)
                pairs[a : a + BLOCK] += np.bincount(who, here, min(BLOCK, len(own) - a)).astype(np.int64)
                for i, j in zip(own[a + who].tolist(), ids[what].tolist()):
                    i, j = find(i), find(j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
            out = pd.DataFrame({"id": own, "links": links, "pairs": pairs, "root": [find(k) for k in own.tolist()]})
            more = [k for k in list(parent) if k not in set(own.tolist())]
            return pd.concat([out, pd.DataFrame({"id": np.array(more, np.int64), "links": np.zeros(len(more), np.int64), "pairs": np.zeros(len(more), np.int64), "root": np.array([find(k) for k in more], np.int64)})])
        return pd.DataFrame({"id": own, "links": links, "pairs": pairs, "root": root})

    return run


def _audit(asked, least: float):
    """Partial counts of the audited vectors' true partners, equal ones once."""

    def run(batches):
        ids, x = asked.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                y = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                hit = (x @ y.T >= least) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                total += hit.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "partners"])

    return run


def _linked(classes: DataFrame, n: int, width: int, least: float, work: Workspace) -> tuple[DataFrame, float]:
    """id, links and component, where found, of n saved classes (id, copies, embedding) of one length, and the audited recall."""
    spark = classes.sparkSession
    unit = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30))
    sample = classes.where(unit <= F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))).select("embedding").toArrow()["embedding"]
    sample = _unit(pd.Series(sample.to_pylist() or [classes.select("embedding").first()[0]]), width)
    mid = centres(sample, max(1, min(len(sample) // 2, -(-n // SHARD))))
    centre = spark.sparkContext.broadcast(mid)
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("salt")
    base = classes.select("id", "copies", "embedding", salt)
    ones = spark.sparkContext.broadcast(np.ones(len(mid), np.int64))
    none = F.array().cast("array<long>").alias("nbrs")
    first = base.select("*", none).mapInArrow(_route(centre, OVERLAP, ones, ones), ROUTED).select("shard")
    sizes = np.zeros(len(mid), np.int64)
    for r in first.groupBy("shard").count().collect():  # one row a shard, of at most SAMPLE / 2
        sizes[r.shard] = r["count"]
    pieces = spark.sparkContext.broadcast(np.maximum(1, -(-sizes // MEMBERS)))
    built = base.select("*", none).mapInArrow(_route(centre, OVERLAP, pieces, ones), ROUTED).groupBy("shard", "piece").applyInPandas(_build(width), "id long, nbrs array<long>")
    lists = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))  # of OVERLAP lists
    whole = work.save(base.join(lists, "id"), "graph").select("id", "copies", "embedding", "salt", "nbrs")
    picked = classes.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(AUDIT).select("id", "copies", "embedding").toArrow()
    asked = spark.sparkContext.broadcast((picked["id"].to_numpy(), _unit(pd.Series(picked["embedding"].to_pylist()), width)))
    truth = {r.id: r.n for r in classes.select("id", "copies", "embedding").mapInArrow(_audit(asked, least), "id long, partners long").groupBy("id").agg(F.sum("partners").alias("n")).collect()}
    beam, probes = BEAM, PROBES
    while True:
        parts = spark.sparkContext.broadcast(np.maximum(1, -(-sizes * probes // (OVERLAP * QUERIES))))
        routed = whole.mapInArrow(_route(centre, probes, pieces, parts), ROUTED)
        found = work.save(routed.groupBy("shard", "piece", "part").applyInPandas(_search(centre, width, least, beam), "id long, links long, pairs long, root long"), "found")
        counts = work.save(found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), "counts")
        got = {r.id: r.pairs for r in counts.where(F.col("id").isin([int(k) for k in truth])).collect()}
        shares = [min(t, got.get(k, 0)) / t for k, t in truth.items() if t]
        recall = sum(shares) / len(shares) if shares else 1.0
        if recall >= LEAST_RECALL or probes >= len(mid) and beam >= MEMBERS:
            break
        work.drop(found, counts)
        beam, probes = 2 * beam, min(2 * probes, max(PROBES, len(mid)))
    if recall < FAILED:
        raise RuntimeError(f"the search finds {recall:.3f} of the audited links, less than {FAILED}")
    tied = graph.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), work)
    return counts.select("id", "links").join(tied.withColumnRenamed("node", "id"), "id", "left"), recall


def similar_vectors(table: DataFrame, least: float = LEAST_COSINE, work: Workspace | None = None) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id, kept of table (vec_id, embedding), and the least audited recall of a length."""
    spark = table.sparkSession
    work = work or Workspace(spark, "vectors")
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    usable = fine & F.coalesce(most > 0, F.lit(False)) & F.col("vec_id").isNotNull()
    # squares that are too large or too small for a double: such a vector is brought to a largest component of 1
    scale = F.when((norm > 1e-200) & (norm < 1e200), 1.0).otherwise(most)
    # -0.0 is 0.0; the scale is bound to a variable, as inside the inner function it would be computed for each component
    keyed = F.get(F.transform(F.array(scale), lambda s: F.transform("embedding", lambda x: x / s + F.lit(0.0))), F.lit(0))
    rows = work.save(rows.select("vec_id", usable.alias("usable"), F.when(usable, keyed).alias("embedding")).withColumn("hash", F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256)), "rows")
    classes = rows.where("usable").groupBy("hash").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = work.save(classes.withColumn("width", F.size("embedding")), "classes")
    named, recall = classes.select("hash", "id", "copies", "width"), 1.0
    sides = []
    for r in classes.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        if r.n > 1:
            links, one = _linked(classes.where(F.col("width") == r.width), r.n, r.width, least, work)
            sides.append(links.withColumn("width", F.lit(r.width)))
            recall = min(recall, one)
    links = spark.createDataFrame([], "id long, links long, component long, width int") if not sides else sides[0]
    for more in sides[1:]:
        links = links.unionByName(more)
    named = named.join(links, ["id", "width"], "left")
    named = work.save(named.select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    out = rows.select("vec_id", "usable", "hash").join(named, "hash", "left")
    out = out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall


def op10_vectors_flat_graph(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))[0]
