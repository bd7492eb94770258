"""Prediction by partial matching over bytes, with frozen statistics.

Counting: every byte of a document, and one end mark, is counted once behind its longest context of up to `order`
bytes (a context never reaches back over the document's start). Shorter contexts' counts are sums of these. A context
belongs to the trie that is sent to executors if it holds at least a share `min_share` of all counted bytes (at most
order / min_share + 1 contexts). Operator 3 keeps the others as a table: Automaton.sure() tells which symbols the trie
settles, and Automaton.behind() settles the rest from the trie and the table's rows of their contexts.

Probabilities (escape method C): behind a context seen T times with D distinct symbols, a seen symbol gets
count / (T + D) and the escape D / (T + D); after an escape the next shorter context leaves out ("excludes") the
symbols that were just ruled out. Below the empty context all symbols not yet excluded are alike.

Scoring: for frozen counts, context + symbol fix both the code length and the next context, so the trie becomes a
table automaton. A batch is cut into a few thousand lanes that step side by side in numpy; a lane first reads the
`order` bytes before its own, after which it is in the state it would have had.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Never a byte of UTF-8: ends a document, and starts the next one's context.
MARK = 0xFF
LANES = 4096
#: Rows of the tables that are made at a time.
ROWS = 4096


def stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes, each document followed by a mark, and the documents' new offsets."""
    n = len(off) - 1
    out = np.insert(buf, off[1:], MARK) if n else np.zeros(0, np.uint8)
    return out, off + np.arange(n + 1)


def grams(symbols: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each symbol a key: its context's bytes (from the document's start mark on) and itself, and their number on top."""
    n = len(symbols)
    wide = np.concatenate([np.full(order, MARK, np.uint8), symbols]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | wide[j : j + n]
    since = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    size = np.minimum(order + 1, since + 2).astype(np.uint64)
    short = np.flatnonzero(size <= order)
    key[short] &= (np.uint64(1) << (size[short] * np.uint64(8))) - np.uint64(1)
    return key | (size << np.uint64(56))


class Counter:
    """Sums of (group, key), merged now and then, so that a task holds the distinct keys of its own rows only."""

    def __init__(self, limit: int = 3_000_000):
        self.parts: dict[int, list] = {}
        self.held, self.limit = 0, limit

    def add(self, group: int, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.setdefault(group, []).append((keys, counts.astype(np.int64)))
        self.held += len(keys)
        if self.held > self.limit:
            self.merge()

    def merge(self) -> None:
        for g, parts in self.parts.items():
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            self.parts[g] = [(keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64))]
        self.held = sum(len(p[0][0]) for p in self.parts.values())

    def full(self) -> bool:
        return self.held > self.limit // 2

    def rows(self, step: int = 200_000):
        """(group, key, n) record batches; empties the counter."""
        self.merge()
        for g, [(keys, counts)] in self.parts.items():
            for a in range(0, len(keys), step):
                k, c = keys[a : a + step], counts[a : a + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["grp", "key", "n"])
        self.parts, self.held = {}, 0


COUNTED = "grp int, key long, n long"


def all_contexts(counted: DataFrame, min_share: float) -> DataFrame:
    """Every context (depth, ctx, grp, symbols, heavy) of counted (grp, key, n) rows of grams(); heavy if its share is large enough."""
    spark = counted.sparkSession
    least = [(r.grp, float(r.n) * min_share) for r in counted.groupBy("grp").agg(F.sum("n").alias("n")).collect()]
    heavy = F.broadcast(spark.createDataFrame(least, "grp int, least double"))
    sizes = F.explode(F.sequence(F.lit(1), F.shiftright("key", 56).cast("int"))).alias("size")
    every = (
        counted.select("grp", sizes, "key", "n")
        .withColumn("key", F.expr("key & (shiftleft(1L, least(size, 7) * 8) - 1)"))
        .select("grp", "size", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n")
        .groupBy("grp", "size", "ctx", "sym")
        .agg(F.sum("n").alias("n"))
    )
    per_ctx = every.groupBy("grp", "size", "ctx").agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("symbols"))
    return per_ctx.join(heavy, "grp").select((F.col("size") - 1).alias("depth"), "ctx", "grp", "symbols", (F.col("total") >= F.col("least")).alias("heavy"))


def contexts(counted: DataFrame, order: int, min_share: float) -> pa.Table:
    """The trie's rows (depth, ctx, grp, symbols) for counted (grp, key, n) rows of grams(); few, for the driver."""
    return all_contexts(counted, min_share).where("heavy").drop("heavy").toArrow()


def suffixes(keys: list, base: np.ndarray) -> np.ndarray:
    """For each state the state of its context without the first byte."""
    out = np.zeros(int(base[-1]), np.int64)
    for d in range(1, len(keys)):
        out[base[d] : base[d + 1]] = base[d - 1] + np.searchsorted(keys[d - 1], keys[d] & ((1 << 8 * (d - 1)) - 1))
    return out


@dataclass
class Trie:
    """Compact, to be broadcast: contexts of each depth, and (context, symbol, group, count) entries."""

    order: int
    keys: list  # for each depth, sorted context keys
    node: np.ndarray
    sym: np.ndarray
    grp: np.ndarray
    n: np.ndarray
    n_groups: int

    @staticmethod
    def build(rows: pa.Table, order: int, n_groups: int) -> Trie:
        rows = rows.combine_chunks()
        depth, ctx, grp = (rows[c].to_numpy() for c in ("depth", "ctx", "grp"))
        lists = rows["symbols"].combine_chunks() if rows["symbols"].num_chunks else pa.array([], rows["symbols"].type)
        each = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
        flat = lists.flatten()
        sym, n = flat.field("sym").to_numpy(), flat.field("n").to_numpy()
        keys = [np.unique(ctx[depth == d]) for d in range(order + 1)]
        if not len(keys[0]):
            keys[0] = np.zeros(1, np.int64)
        for d in range(1, order + 1):  # a suffix is at least as frequent, so this takes nothing away
            keys[d] = keys[d][np.isin(keys[d] & ((1 << 8 * (d - 1)) - 1), keys[d - 1])]
        base = np.cumsum([0, *map(len, keys)])
        node = np.zeros(len(ctx), np.int32)
        for d in range(order + 1):
            own = depth == d
            node[own] = base[d] + np.searchsorted(keys[d], ctx[own])
        return Trie(order, keys, np.repeat(node, each), sym.astype(np.uint8), np.repeat(grp, each).astype(np.int32), n.astype(np.float64), n_groups)

    def only(self, groups: range) -> Trie:
        """The trie of some groups: with a context, a group has its suffixes, too."""
        own = (self.grp >= groups.start) & (self.grp < groups.stop)
        used = np.zeros(sum(map(len, self.keys)), bool)
        used[self.node[own]] = used[: len(self.keys[0])] = True
        base = np.cumsum([0, *map(len, self.keys)])
        keys = [k[used[a:b]] for k, a, b in zip(self.keys, base[:-1], base[1:])]
        node = (np.cumsum(used) - 1)[self.node[own]].astype(np.int32)
        return Trie(self.order, keys, node, self.sym[own], self.grp[own] - np.int32(groups.start), self.n[own], len(groups))


class Automaton:
    """states x symbols tables of a trie: the next state, and log2 probabilities for each group.

    whole_only: keep NaN for symbols whose longest context isn't in the trie. Tables are made a depth and some rows at a
    time, so that making them takes little more memory than holding them."""

    def __init__(self, trie: Trie, whole_only: bool = False):
        self.order, self.trie = trie.order, trie
        seen = np.unique(np.concatenate([trie.sym, np.array([MARK], np.uint8)]))
        self.width = width = len(seen) + 1  # the last column: bytes never seen
        self.column = np.full(256, width - 1, np.int32)
        self.column[seen] = np.arange(len(seen))
        base = np.cumsum([0, *map(len, trie.keys)])
        states = int(base[-1])
        suffix = suffixes(trie.keys, base)
        self.logp = np.empty((states, width, trie.n_groups), np.float32)
        for g in range(trie.n_groups):
            own = trie.grp == g
            self._code_lengths(trie.node[own], self.column[trie.sym[own]], trie.n[own], base, suffix, self.logp[:, :, g])
        if whole_only:
            whole = [np.full(len(k), d == self.order) | (d > 0) & (k >> 8 * max(0, d - 1) == MARK) for d, k in enumerate(trie.keys)]
            self.logp[~np.concatenate(whole)] = np.nan
        self.next = self._transitions(trie, seen, base, suffix)
        self.next *= np.int32(width)
        self.next = self.next.ravel()
        self.logp = self.logp.reshape(states * width, trie.n_groups)
        if trie.n_groups == 1:
            self.logp = self.logp.ravel()
        self.start = int(self.next[self.column[MARK]])

    def _transitions(self, trie: Trie, seen: np.ndarray, base: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = np.zeros((int(base[-1]), self.width), np.int32)
        for d in range(trie.order + 1):
            for a in range(base[d], base[d + 1], ROWS):
                rows = slice(a, min(a + ROWS, base[d + 1]))
                if d:
                    out[rows] = out[suffix[rows]]
                if d < trie.order and len(trie.keys[d + 1]):
                    grown = (trie.keys[d][a - base[d] : rows.stop - base[d], None] << 8) | seen[None, :].astype(np.int64)
                    at = np.minimum(np.searchsorted(trie.keys[d + 1], grown), len(trie.keys[d + 1]) - 1)
                    out[rows, :-1] = np.where(trie.keys[d + 1][at] == grown, base[d + 1] + at, out[rows, :-1])
        mark = trie.keys[1][trie.keys[1] == MARK] if trie.order else []
        out[:, self.column[MARK]] = base[1] + np.searchsorted(trie.keys[1], MARK) if len(mark) else 0
        return out

    def _code_lengths(self, node: np.ndarray, col: np.ndarray, n: np.ndarray, base: np.ndarray, suffix: np.ndarray, out: np.ndarray) -> np.ndarray:
        """log2 probabilities into out, states x symbols, for entries (node, col, n)."""
        states = int(base[-1])
        total, kinds = np.bincount(node, n, states), np.bincount(node, minlength=states).astype(float)
        order = np.argsort(node, kind="stable")
        node, col, n = node[order], col[order], n[order]
        first = np.searchsorted(node, base)
        count = below = up_count = up_below = np.zeros((0, self.width), np.float32)
        for d in range(len(base) - 1):
            up_count, up_below, size = count, below, int(base[d + 1] - base[d])
            own = slice(first[d], first[d + 1])
            local, columns = node[own] - base[d], col[own]
            count, below = np.zeros((size, self.width), np.float32), np.empty((size, self.width), np.float32)
            count[local, columns] = n[own]
            rows = slice(base[d], base[d + 1])
            if d:
                up = suffix[rows] - base[d - 1]
                # what each state's own symbols hold in its suffix, to be excluded there after an escape
                gone = np.bincount(local, up_count[up[local], columns], size)
                left = np.maximum(0, total[suffix[rows]] - gone), np.maximum(0, kinds[suffix[rows]] - kinds[rows])
            with np.errstate(divide="ignore", invalid="ignore"):  # of entries that np.where leaves out
                escape = np.where(total[rows] > 0, np.log2(kinds[rows] / (total[rows] + kinds[rows])), 0).astype(np.float32)
                bound = np.where(total[rows] > 0, np.log2(total[rows] + kinds[rows]), 0).astype(np.float32)
                if d:
                    cut_bound = np.where(left[0] + left[1] > 0, np.log2(left[0] + left[1]), 0)
                    cut_escape = np.where(left[1] > 0, np.log2(left[1]) - cut_bound, 0).astype(np.float32)
                    cut_bound = cut_bound.astype(np.float32)
                else:
                    below[:] = -np.log2(257 - kinds[0])
                for a in range(0, size, ROWS):
                    cut = slice(a, a + ROWS)
                    if d:  # behind an escape from the state
                        seen = up_count[up[cut]]
                        below[cut] = np.where(seen > 0, np.log2(seen) - cut_bound[cut, None], cut_escape[cut, None] + up_below[up[cut]])
                    out[base[d] + a : min(base[d] + a + ROWS, base[d + 1])] = np.where(count[cut] > 0, np.log2(count[cut]) - bound[cut, None], escape[cut, None] + below[cut])
        return out

    def score(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log2 probability of each document of a marked stream: one row a document, one column a group."""
        if not len(symbols):
            docs = len(off) - 1
            return np.zeros((docs,) if self.logp.ndim == 1 else (docs, self.logp.shape[1]))
        return np.add.reduceat(self._walk(symbols, self.logp), off[:-1], axis=0, dtype=np.float64)  # each document has its mark, so none is empty

    def sure(self, symbols: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol of a marked stream whose longest context is in the trie, and NaN for the others;
        of one group, and of an automaton made with whole_only."""
        return self._walk(symbols, self.logp) if len(symbols) else np.zeros(0, np.float32)

    def behind(self, depth: np.ndarray, ctx: np.ndarray, sym: np.ndarray, rare: tuple) -> np.ndarray:
        """log2 probability of symbols sym behind contexts (depth, ctx), with the trie and rare contexts' entries (depth,
        ctx, sym, n), among which are all entries of these contexts and their suffixes that the trie lacks; one group."""
        trie, (rare_depth, rare_ctx, rare_sym, rare_n) = self.trie, rare
        old = np.cumsum([0, *map(len, trie.keys)])
        keys, known = [], []
        for d, mine in enumerate(trie.keys):
            own = np.unique(ctx[depth >= d] & ((1 << 8 * d) - 1))
            known.append(np.union1d(own[np.isin(own, mine)], mine if d == 0 else mine[:0]))
            keys.append(np.union1d(known[d], rare_ctx[rare_depth == d]))
        base = np.cumsum([0, *map(len, keys)])
        new = np.full(int(old[-1]), -1, np.int64)
        node, at = np.zeros(len(rare_ctx), np.int64), np.zeros(len(ctx), np.int64)
        for d, mine in enumerate(keys):
            new[old[d] + np.searchsorted(trie.keys[d], known[d])] = base[d] + np.searchsorted(mine, known[d])
            own = rare_depth == d
            node[own] = base[d] + np.searchsorted(mine, rare_ctx[own])
            if len(mine):
                cut = ctx & ((1 << 8 * d) - 1)
                spot = np.minimum(np.searchsorted(mine, cut), len(mine) - 1)
                at = np.where((depth >= d) & (mine[spot] == cut), base[d] + spot, at)
        kept = new[trie.node] >= 0
        node = np.concatenate([new[trie.node[kept]], node])
        column = self.column[np.concatenate([trie.sym[kept], rare_sym.astype(np.uint8)])]
        lengths = np.empty((int(base[-1]), self.width), np.float32)
        return self._code_lengths(node, column, np.concatenate([trie.n[kept], rare_n]), base, suffixes(keys, base), lengths)[at, self.column[sym]]

    def _walk(self, symbols: np.ndarray, table_of: np.ndarray) -> np.ndarray:
        """What the table holds for each symbol of a marked stream."""
        n = len(symbols)
        lanes = min(LANES, max(1, n // (8 * self.order + 8)))
        steps = -(-n // lanes)
        padded = np.full(self.order + lanes * steps, self.column[MARK], np.int32)
        padded[: self.order] = self.column[MARK]
        padded[self.order : self.order + n] = self.column[symbols]
        table = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (self.order + steps, lanes), (4, 4 * steps)))
        state = np.full(lanes, self.start, np.int32)
        for t in range(self.order):
            state = self.next[state + table[t]]
        got = np.empty((steps, lanes, *table_of.shape[1:]), np.float32)
        for t in range(steps):
            at = state + table[self.order + t]
            np.take(table_of, at, axis=0, out=got[t])
            state = self.next[at]
        return got.swapaxes(0, 1).reshape(lanes * steps, *table_of.shape[1:])[:n]
