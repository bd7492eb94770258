"""Operator 5, toxicity: a bidirectional gated recurrent network with attention pooling, over characters and words.

A word's input is the embedding of its hash beside the mean of the embeddings of its byte 4- and 5-grams (with marks
at its ends). Windows of WINDOW words every STRIDE words cover the whole text; in each, two gated recurrent units read
the words forwards and backwards, attention pools their states, and a linear layer gives the window's logit. A text is
as toxic as its worst window. Training is in numpy on the driver, on at most TOXIC + CLEAN labelled texts of at most
TRAIN_BYTES each: the first column of the embeddings starts from log odds, then Adam follows the gradient through each
text's worst window. Scoring is a pass over the documents with the model (about 2 MB) broadcast.

Defined results: a null or empty text is one window without words, whose logit is the output bias; with no label of one
kind to learn from, every score is the share of toxic labels (0.5 without any); repeated rows are rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.langid import held_out
from lamella.llm.textkit import LOWER, Words, column_bytes, pieces

WINDOW, STRIDE = 32, 24
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 15, 8, 8, 8, 8
GRAMS = (4, 5)
TOXIC, CLEAN, TRAIN_BYTES = 1500, 3000, 1 << 16
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 500, 64, 0.01
_GRAM = np.random.default_rng(5).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Inputs:
    """The words of some texts: word (number of the distinct word) of each, first word of each text, and for the
    distinct words their word bucket, and the buckets of their character grams with offsets."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        words = Words(buf, off)
        distinct, at, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.distinct, self.first = distinct, words.first
        self.bucket = (distinct >> np.uint64(49)).astype(np.int64) % BUCKETS
        size = words.ends[at] - words.starts[at] + 2
        end = np.cumsum(size)
        begin = end - size
        if not len(size):
            self.gram, self.gram_off = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        place = np.arange(end[-1]) + np.repeat(words.starts[at] - 1 - begin, size)
        text = LOWER[buf[np.clip(place, 0, len(buf) - 1)]].astype(np.uint32)
        text[begin], text[end - 1] = 2, 3
        owner = np.repeat(np.arange(len(size)), size)
        found, of = [], []
        for n in GRAMS:
            if len(text) >= n:
                h = sum(text[j : len(text) - n + 1 + j] * _GRAM[j] for j in range(n)) + np.uint32(n)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                inside = owner[: len(text) - n + 1] == owner[n - 1 :]
                found.append((h >> np.uint32(17))[inside])
                of.append(owner[: len(text) - n + 1][inside])
        of = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        self.gram = (np.concatenate(found)[order] if found else np.zeros(0)).astype(np.int64) % BUCKETS
        self.gram_off = np.searchsorted(of[order], np.arange(len(size) + 1))

    @staticmethod
    def joined(texts: pa.Array):
        """The inputs of many texts, made from a few MB at a time."""
        buf, off = column_bytes(texts)
        parts = [Inputs(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off)]
        out = Inputs.__new__(Inputs)
        cat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        out.distinct, at, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p.distinct for p in parts)]), return_index=True, return_inverse=True)
        out.bucket = cat(p.bucket for p in parts)[at]
        base = np.cumsum([0, *(len(p.gram) for p in parts)])
        each, start = cat(np.diff(p.gram_off) for p in parts)[at], cat(p.gram_off[:-1] + b for p, b in zip(parts, base))[at]
        out.gram_off = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        out.gram = cat(p.gram for p in parts)[np.repeat(start - out.gram_off[:-1], each) + np.arange(out.gram_off[-1])]
        begin = np.cumsum([0, *(len(p.distinct) for p in parts)])
        out.word = cat(back[p.word + b] for p, b in zip(parts, begin))
        done = np.cumsum([0, *(len(p.word) for p in parts)])
        out.first = np.concatenate([*(p.first[:-1] + n for p, n in zip(parts, done)), [done[-1]]]).astype(np.int64)
        return out

    def only(self, words: np.ndarray):
        """The inputs of some distinct words alone."""
        out = Inputs.__new__(Inputs)
        each = np.diff(self.gram_off)[words]
        out.bucket, out.gram_off = self.bucket[words], np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        out.gram = self.gram[np.repeat(self.gram_off[words] - out.gram_off[:-1], each) + np.arange(out.gram_off[-1])]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1 for none) of all windows, and the first window of each text, with the end."""
        count = np.diff(self.first)
        each = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        at = np.concatenate([[0], np.cumsum(each)])
        text = np.repeat(np.arange(len(count)), each)
        start = self.first[text] + (np.arange(at[-1]) - at[text]) * STRIDE
        place = start[:, None] + np.arange(WINDOW)[None, :]
        fine = place < self.first[text + 1][:, None]
        if not len(self.word):
            return np.full(place.shape, -1), at, text
        return np.where(fine, self.word[np.where(fine, place, 0)], -1), at, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": 0.05 * normal(BUCKETS, WORD_DIM) * np.sqrt(BUCKETS), "chars": 0.05 * normal(BUCKETS, CHAR_DIM) * np.sqrt(BUCKETS)}
        for k in "fb":
            self.p |= {f"w{k}": normal(d, 3 * h), f"u{k}": normal(h, 2 * h), f"n{k}": normal(h, h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p |= {"wa": normal(2 * h, ATTEND), "ca": np.zeros(ATTEND, np.float32), "va": normal(ATTEND), "out": normal(2 * h), "bias": np.zeros(1, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vectors(self, x: Inputs) -> np.ndarray:
        """Inputs of the distinct words; a last row of zeros stands for no word."""
        n = len(x.bucket)
        out = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:n, :WORD_DIM] = self.p["words"][x.bucket]
        each = np.diff(x.gram_off)
        has = each > 0
        if has.any():
            total = np.add.reduceat(self.p["chars"][x.gram], x.gram_off[:-1][has], axis=0)
            out[:n][has, WORD_DIM:] = total / each[has, None]
        return out

    def _read(self, k: str, project: np.ndarray, idx: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, steps x windows x HIDDEN."""
        u, un, h3 = self.p[f"u{k}"], self.p[f"n{k}"], HIDDEN
        steps = range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((len(idx), HIDDEN), project.dtype)
        out = np.empty((WINDOW, len(idx), HIDDEN), project.dtype)
        for t in steps:
            x = project[idx[:, t]]
            gates = _sigmoid(x[:, : 2 * h3] + h @ u)
            z, r = gates[:, :h3], gates[:, h3:]
            n = np.tanh(x[:, 2 * h3 :] + (r * h) @ un)
            on = (idx[:, t] >= 0)[:, None]
            new = np.where(on, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, on))
            h = out[t] = new
        return out

    def projected(self, vectors: np.ndarray) -> dict:
        return {k: vectors @ self.p[f"w{k}"] + self.p[f"c{k}"] for k in "fb"}

    def forward(self, vectors: np.ndarray, idx: np.ndarray, keep: dict | None = None, projected: dict | None = None) -> np.ndarray:
        """Logits of windows (word numbers, -1 for none)."""
        projected = projected or self.projected(vectors)
        hs = []
        for k in "fb":
            steps = [] if keep is not None else None
            hs.append(self._read(k, projected[k], idx, steps))
            if keep is not None:
                keep[k] = steps
        h = np.concatenate(hs, axis=2)
        a = np.tanh(h @ self.p["wa"] + self.p["ca"])
        e = np.where((idx >= 0).T, a @ self.p["va"], -1e9)
        weight = np.exp(e - e.max(0))
        weight = np.where((idx >= 0).T, weight, 0)
        weight /= np.maximum(weight.sum(0), 1e-30)
        pooled = np.einsum("tw,twh->wh", weight, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, x: Inputs, vectors: np.ndarray, idx: np.ndarray, d_logit: np.ndarray, keep: dict) -> dict:
        """Of sum(logit * d_logit) by all parameters; for the embeddings, (rows, gradients) of those in use."""
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "chars")}
        h, a, weight = keep["h"], keep["a"], keep["weight"]
        g["bias"][0] = d_logit.sum()
        g["out"] = keep["pooled"].T @ d_logit
        d_pooled = d_logit[:, None] * self.p["out"]
        dh = weight[:, :, None] * d_pooled
        d_weight = np.einsum("wh,twh->tw", d_pooled, h)
        de = weight * (d_weight - (weight * d_weight).sum(0))
        g["va"] = np.einsum("tw,twk->k", de, a)
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        g["wa"], g["ca"] = np.einsum("twh,twk->hk", h, da), da.sum((0, 1))
        dh = dh + da @ self.p["wa"].T
        d_vec = np.zeros_like(vectors)
        for half, k in enumerate("fb"):
            u, un = self.p[f"u{k}"], self.p[f"n{k}"]
            own = dh[:, :, half * HIDDEN : (half + 1) * HIDDEN]
            d_project = np.zeros((len(vectors), 3 * HIDDEN), vectors.dtype)
            back = np.zeros((len(idx), HIDDEN), vectors.dtype)
            for t, h0, z, r, n, on in reversed(keep[k]):
                back = back + own[t]
                live = np.where(on, back, 0)
                dz, dn = live * (h0 - n) * z * (1 - z), live * (1 - z) * (1 - n * n)
                d_rh = dn @ un.T
                dr = d_rh * h0 * r * (1 - r)
                gates = np.concatenate([dz, dr], 1)
                g[f"n{k}"] += (r * h0).T @ dn
                g[f"u{k}"] += h0.T @ gates
                back = np.where(on, live * z + d_rh * r + gates @ u.T, back)
                np.add.at(d_project, idx[:, t], np.concatenate([gates, dn], 1))
            d_project[-1] = 0  # no word
            g[f"w{k}"], g[f"c{k}"] = vectors.T @ d_project, d_project.sum(0)
            d_vec += d_project @ self.p[f"w{k}"].T
        n, each = len(x.bucket), np.diff(x.gram_off)
        for k, at, d in (("words", x.bucket, d_vec[:n, :WORD_DIM]), ("chars", x.gram, np.repeat(d_vec[:n, WORD_DIM:] / np.maximum(each, 1)[:, None], each, axis=0))):
            rows, back = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows), d.shape[1]), vectors.dtype)
            np.add.at(total, back, d)
            g[k] = rows, total
        return g

    def texts(self, x: Inputs) -> np.ndarray:
        """Logits of texts: of their worst windows."""
        idx, at, _ = x.windows()
        vectors = self.vectors(x)
        ready = self.projected(vectors)
        logits = np.concatenate([self.forward(vectors, idx[a : a + 4096], projected=ready) for a in range(0, len(idx), 4096)])
        return np.maximum.reduceat(logits, at[:-1])


def _log_odds(features, toxic: np.ndarray) -> np.ndarray:
    """How much likelier toxic texts hold each bucket, shrunk where few do; features: runs of (bucket, text) arrays."""
    held = np.zeros((2, BUCKETS))
    for bucket, text in features:
        pair = np.unique(text * BUCKETS + bucket)
        hit = toxic[pair // BUCKETS]
        for k in (0, 1):
            held[k] += np.bincount(pair[hit == k] % BUCKETS, minlength=BUCKETS)
    b, a = held
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    return np.clip(odds * (a + b) / (a + b + 5) / 3, -1, 1.5)


def train(texts: list[str], toxic: np.ndarray, epochs: int | None = None, seed: int = 5) -> Network:
    epochs = epochs or max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    net, rng = Network(seed), np.random.default_rng(seed)
    x = Inputs.joined(pa.array(texts, pa.string()))

    def features(chars: bool):
        for a in range(0, len(texts), 100):
            b = min(a + 100, len(texts))
            word, text = x.word[x.first[a] : x.first[b]], np.repeat(np.arange(a, b), np.diff(x.first[a : b + 1]))
            if chars:
                word, text = np.divmod(np.unique(word * len(texts) + text), len(texts))
                part = x.only(word)
                yield part.gram, np.repeat(text, np.diff(part.gram_off))
            else:
                yield x.bucket[word], text

    net.p["words"][:, 0], net.p["chars"][:, 0] = _log_odds(features(False), toxic), _log_odds(features(True), toxic)
    idx, at, _ = x.windows()
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):  # the worst window of each text, as the network sees it every now and then, stands for it
        if epoch % (epochs // EPOCHS or 1) == 0:
            vectors = net.vectors(x)
        if epoch and epoch % (epochs // EPOCHS or 1) == 0:
            ready = net.projected(vectors)
            value = np.concatenate([net.forward(vectors, idx[a : a + 4096], projected=ready) for a in range(0, len(idx), 4096)])
        elif not epoch:
            value = (vectors[:, 0] + vectors[:, WORD_DIM])[idx].max(1)
        worst = np.array([a + int(value[a:b].argmax()) for a, b in zip(at[:-1], at[1:])])
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            words = np.unique(idx[worst[docs]])
            words = words[words >= 0]
            local = np.where(idx[worst[docs]] < 0, -1, np.searchsorted(words, idx[worst[docs]]))
            part, keep = x.only(words), {}
            vectors = net.vectors(part)
            logit = net.forward(vectors, local, keep)
            g = net.gradient(part, vectors, local, ((_sigmoid(logit) - toxic[docs]) / len(docs)).astype(np.float32), keep)
            step += 1
            for k, p in net.p.items():
                rows, d = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
                m[k][rows] += 0.1 * (d - m[k][rows])
                v[k][rows] += 0.001 * (d * d - v[k][rows])
                p[rows] -= RATE * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(v[k][rows] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Network | float:
    """A network from docs (doc_id, text) and labels (doc_id, toxic), or the share of toxic labels if one kind is missing.

    The labels are sampled first, by a hash of their doc_id, so that a bounded number of ids is broadcast to the texts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic / counts[1])).otherwise(min(1.0, clean / counts[0]))
    sample = F.broadcast(known.where(unit < share).dropDuplicates())
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(sample, "doc_id").select("text", "toxic").toArrow().to_pylist()
    found.sort(key=lambda r: (r["toxic"], r["text"]))
    if len({r["toxic"] for r in found}) < 2:
        return counts[1] / (counts[0] + counts[1])
    return train([r["text"] for r in found], np.array([r["toxic"] == 1 for r in found]))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of docs (doc_id, text)."""
    if not isinstance(model, Network):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model.p)

    def run(batches):
        net = Network.__new__(Network)
        net.p = held.value
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            for a, b in pieces(off):
                logits = net.texts(Inputs(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_sigmoid(logits.astype(np.float64)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity_gru(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = F.coalesce(held_out(5, 0), F.lit(False))
    model = fit(docs, labels.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
