"""Chat formatting, mixing, toxicity, and the pipeline as a whole."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import toxicity as X
from lamella.llm.chat import format_conversations, read_conversations
from lamella.llm.mixing import flight, mix, targets
from lamella.llm.textkit import column_bytes

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi </s><s>"),
        (1, 1, "user", "[TURN] <\\/s> \\ [MORE]"),
        (1, 2, "assistant", "ok\n[/INST] <\\\\s>"),
        (1, 3, "assistant", ""),
        (2, 0, None, None),
        (3, 1, "[MORE]", "x"),
        (3, None, "assistant", "é☃"),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
        (None, 0, "assistant", "no id"),
    ]
    made = format_conversations(spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", n int"))
    got = {r.conv_id: r for r in read_conversations(made).collect()}
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: list(r.loss_texts) for c, r in got.items()} == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    text = {r.conv_id: r.formatted for r in made.collect()}
    assert text[1].count("</s>") == 2 and text[1].count("[TURN]") == 2 and len(text[1]) == got[1].formatted_chars
    assert read_conversations(format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_query(spark):
    from lamella.llm.chat import op7_chat_format

    row = op7_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    trap = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(trap.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()


def test_targets():
    assert targets({"a": 100, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}) == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3})
    assert targets({"a": 10, "b": 1000}, {"a": 3, "b": 1}) == pytest.approx({"a": 20, "b": 1495})
    assert targets({}, {}) == {}


def test_flight_balances():
    rng = random.Random(1)
    sizes, probs = [rng.randrange(1, 500) for _ in range(2000)], [0.3] * 2000
    order = sorted(range(2000), key=lambda i: -sizes[i])
    sizes = [sizes[i] for i in order]
    out = flight(sizes, probs, random.Random(2), True)
    assert set(out) <= {0.0, 1.0}
    assert abs(sum(out) - 600) <= 10 and abs(sum(s * o for s, o in zip(sizes, out)) - 0.3 * sum(sizes)) <= 20
    means = np.mean([flight(sizes[:300], [0.25] * 300, random.Random(k), True) for k in range(2000)], axis=0)
    assert abs(means.mean() - 0.25) < 0.01 and np.abs(means - 0.25).max() < 0.2
    open_ = [p for p in flight(sizes, probs, random.Random(2), False) if 0 < p < 1]
    assert 0 < len(open_) < 60


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 80)), rng.choice(["b", "a", "c", None])) for i in range(3000)] + [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (9999, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block=200).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    per = {}
    for r in got:
        size, target, taken = per.get(r.source, (0, r.target, 0))
        per[r.source] = (size + r.size, r.target, taken + r.size * r.copies)
        assert r.target <= 2 * r.source_size
    assert all(abs(taken - target) <= 60 for _, target, taken in per.values())
    assert per["empty"] == (0, 0.0, 0)
    again = mix(df.repartition(7), block=200).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in rs)
    assert key(got) == key(again)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_network_gradient():
    net = X.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = X.Inputs(*column_bytes(pa.array(["a bad dog ran over the hill", "hello", "", "x " * 40])))
    idx, at, _ = x.windows()
    d = np.linspace(-1, 1, len(idx))
    keep: dict = {}
    vectors = net.vectors(x).astype(float)
    net.forward(vectors, idx, keep)
    g = net.gradient(x, vectors, idx, d, keep)
    value = lambda: float(net.forward(net.vectors(x).astype(float), idx) @ d)
    for k, p in net.p.items():
        if isinstance(g[k], tuple):
            whole = np.zeros_like(p)
            whole[g[k][0]] = g[k][1]
            g[k] = whole
        at = np.unravel_index(np.abs(g[k]).argmax(), p.shape)
        old, step = p[at], 1e-3 if k in ("words", "chars") else 1e-5
        p[at] = old + step
        up = value()
        p[at] = old - step
        down = value()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[k][at], rel=2e-2, abs=1e-5)


def test_windows_cover_texts():
    for n in (0, 1, 32, 33, 100):
        x = X.Inputs(*column_bytes(pa.array([" ".join(f"w{i}" for i in range(n))])))
        idx, at, _ = x.windows()
        assert set(idx[idx >= 0].tolist()) == set(x.word.tolist()) and at.tolist() == [0, len(idx)] and len(idx) >= 1


def test_toxicity_learns(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]

    def text(bad):
        ws = rng.choices(plain, k=rng.randrange(20, 120))
        for _ in range(3 if bad else 0):
            ws[rng.randrange(len(ws))] = rng.choice(["idiot", "vequ" + rng.choice("abcdefg") * 3])
        return " ".join(ws)

    rows = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(500)]
    rows += [(None, 1), ("x", None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, (_, y) in enumerate(rows)), (None, 1), (9999, 1), (0, rows[0][1])], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    test = [(i, text(i % 2 == 0)) for i in range(200)] + [(1000, None), (1001, ""), (1002, "w1 " * 30000 + "idiot vequxxx idiot")]
    got = {r.doc_id: r.score for r in X.score(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 0) for i in range(200)]) > 0.95
    assert got[1000] == got[1001] < 0.5 and got[1002] > 0.5 and all(0 <= s <= 1 for s in got.values())
    assert X.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) == 1.0
    assert X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) == 0.5


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    import corpus_pipeline as P
    from lamella.workspace import Workspace

    sf, work = "/root/testdata/sf0.001", Workspace(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1234 !!", None, "src0", 7), (10**6 + 1, None, None, None, 0)], docs.schema)
    steps = [docs.unionByName(extra).withColumn("key", F.lit(1))]
    for name, stage in P.STAGES:
        steps.append(work.save(stage(spark, steps[-1], sf), name))
    first, lang, dedup, clean, mixed, tokens = ([r.asDict() for r in s.collect()] for s in steps)
    assert all(s.columns == P.COLUMNS for s in steps[1:-1])
    assert {r["doc_id"] for r in lang} == {r["doc_id"] for r in first} - {10**6, 10**6 + 1}
    from tests.llm.test_pairs import brute

    groups = brute([(r["doc_id"], r["text"]) for r in lang], 80)
    assert {r["doc_id"] for r in dedup} == {d for d, (_, c) in groups.items() if c == d}
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    items = [grams(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in dedup if any(len(i & grams(r["text"])) >= 0.8 * len(i) for i in items)}
    assert leaked and {r["doc_id"] for r in clean} == {r["doc_id"] for r in dedup} - leaked
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert max(np.unique([r["doc_id"] for r in mixed], return_counts=True)[1]) <= 2
    assert [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in mixed)
    assert P.run(spark, sf).count() > 0


def test_pipeline_keeps_rows(spark):
    """Rows without an id and rows that share one are rows of their own in each stage."""
    import corpus_pipeline as P

    rng, sf = random.Random(9), "/root/testdata/sf0.001"
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    base = text()
    near = [f"x{i}" if i == 30 else w for i, w in enumerate(base)]  # 91 of 101 shingles
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    clean = [(None, text()), (None, text()), (7, text()), (7, text()), (7, text())]
    rows = [*clean, (1, base), (2, near), (None, near), (8, [item]), (None, [*text(), item]), (8, text())]
    docs = spark.createDataFrame([(d, " ".join(t), "en", "src0", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()))
    want = lambda rs: sorted((str(d), " ".join(t)) for d, t in rs)
    assert got(P.near_dedup(spark, docs, sf)) == want([r for r in rows if r[1] is not near])
    assert got(P.decontaminate(spark, docs, sf)) == want([r for r in rows if item not in r[1]])
    taken = got(P.mixture(spark, docs, sf))
    assert set(taken) == set(got(docs)) and all(1 <= taken.count(r) <= 2 for r in taken)


def test_toxicity_trains_on_long_texts(spark):
    texts = [(i, "w1 w2 " * 7000 + "idiot" if i % 2 else f"w{i} w2") for i in range(8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    assert isinstance(X.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels), X.Network)
