"""Near duplicates, paragraphs, leaks, vectors: against brute force."""

import random
import re

import numpy as np

from lamella.llm import decontam, graph
from lamella.llm.neardup import near_duplicates
from lamella.llm.paragraphs import repeated_passages
from lamella.llm.vectors import Search, robust_prune, similar_vectors
from lamella.workspace import Workspace

DOCS = "doc_id long, text string"


def words(rng, n, kinds=3000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def brute(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    root = {x: x for ab in links for x in ab}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows, n = [(1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "a b c")], 10
    for family in range(4):
        base = words(rng, 150)
        for k in range(30):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + k, " ".join(words(rng, 60))) for k in range(40)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", id int, key int, component long")
    got = near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    repeated = near_duplicates(spark.createDataFrame([(7, "x y z"), (7, "x y z"), (None, "x y z"), (None, None)], DOCS)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in repeated) == [("7", "7", True), ("7", "7", True), ("None", "None", False), ("None", "None", False)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def shared_runs(rows, n):
    """Documents that share n words in a row with another one."""
    own = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for i in range(len(w) - n + 1):
            own.setdefault(tuple(w[i : i + n]), set()).add(d)
    return set().union(*(s for s in own.values() if len(s) > 1))


def test_paragraphs(spark):
    """A passage inside long lines, across lines, in short lines, changed here and there; what is shorter is left alone."""
    rng = random.Random(2)
    new = lambda n: words(rng, n, 10**6)
    inside, wrapped, many, near, short = new(51), new(60), new(55), new(120), new(40)
    changed = [f"x{i}" if i in (40, 80) else w for i, w in enumerate(near)]
    rows = [
        (1, " ".join(new(70) + inside + new(90))),
        (2, " ".join(new(33) + inside + new(8))),
        (3, " ".join(new(20) + wrapped + new(20))),
        (4, "\n".join(" ".join(wrapped[i : i + 7]) for i in range(0, 60, 7))),
        (5, "\n".join(" ".join(w).upper() for w in zip(many[0::3], many[1::3], many[2::3]))),
        (6, " ".join(new(300) + many + new(1))),
        (7, " ".join(near)),
        (8, " ".join(new(50) + changed)),
        (9, " ".join(new(60) + short + new(60))),
        (10, " ".join(new(30) + short + new(80))),
        (11, " ".join((own := new(80)) + own)),
        (12, " ".join(new(49))),
        (13, None),
        (14, ""),
        (15, "w " * 30_000),
        (None, " ".join(inside)),
    ]
    rows += [(20 + k, " ".join(new(40 + 3 * k) + wrapped + new(60))) for k in range(20)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", h int, cluster int, pos long")
    got = {}
    for r in repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.words, r.first_doc_id, r.removed))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8} | {20 + k for k in range(20)} == shared_runs([r for r in rows if r[0] is not None], 45) | {7, 8}
    for d, at, n, first in ((1, 70, 51, 1), (2, 33, 51, 1), (3, 20, 60, 3), (4, 0, 60, 3), (6, 300, 54, 5), (25, 55, 60, 3)):
        [(start, length, of, removed)] = got[d]
        assert at <= start <= at + 4 and at + n - 4 <= start + length <= at + n and of == first and removed == (d != first)
    assert all(not r[3] for r in got[7]) and all(r[3] for r in got[8])
    again = repeated_passages(spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (1, rows[1][1])], DOCS))
    assert again.count() == 0 and repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_paragraph_links_in_one_text(spark):
    """Paragraphs that are like an earlier one of their own text are linked with those of other texts, too."""
    from lamella.llm.paragraphs import SIZE, SPAN, Paragraphs

    def found(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return Paragraphs(buf, np.array([0, len(buf)]))

    rng, rows, root, owner, expected = random.Random(4), [], {}, {}, set()
    new = lambda n: words(rng, n, 10**6)
    for k in range(60):
        base = new(130)
        at = [int(p) for p in found(" ".join(base)).pos]
        early, late = list(base), list(base)
        for p in at:
            early[p + SIZE - 2], late[p + SIZE - 1] = new(2)
        rows += [(2 * k, " ".join(new(40) + early + new(40) + base)), (2 * k + 1, " ".join(new(50) + late + new(30)))]

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k in range(0, len(rows), 2):
        nodes = []
        for d, t in rows[k : k + 2]:
            paragraphs = found(t)
            keys = paragraphs.keys()[0]
            nodes += [((d, int(p)), set(s.tolist()), key) for p, s, key in zip(paragraphs.pos, paragraphs.sets(), keys)]
        for x, s, key in nodes:
            for y, t, other in nodes:
                if x < y and (key == other).any() and 100 * len(s & t) >= 80 * len(s | t):
                    root[top(x)] = top(y)
        for x, _, _ in nodes:
            owner.setdefault(top(x), set()).add(x[0])
        for d, _ in rows[k : k + 2]:
            chain = []
            for p in sorted(x[1] for x, _, _ in nodes if x[0] == d and len(owner[top(x)]) > 1):
                chain = [*chain, p] if chain and p - chain[-1] <= SPAN else [p]
                if chain[-1] + SIZE - chain[0] >= 50:
                    expected.add(d)
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(expected) > 20 and expected <= got <= expected | shared_runs(rows, 45)


def test_paragraphs_of_a_text_that_repeats_itself(spark):
    """A run of such a text is found wherever in it the other document begins, and grown to its ends."""
    rng, rows = random.Random(5), []
    new = lambda n: words(rng, n, 10**6)
    for k in range(30):
        block = new(20)
        rows += [(2 * k, " ".join(new(50) + block * 10 + new(50))), (2 * k + 1, " ".join(new(50) + (block * 4)[k % 20 :][:50] + new(50)))]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.start + r.words, r.removed))
    assert set(got) == shared_runs(rows, 50) == set(range(60))
    for k in range(0, 60, 2):
        one, two = (t.split() for _, t in rows[k : k + 2])
        for d, w, other, end in ((k, one, two, 250), (k + 1, two, one, 100)):
            runs = {tuple(other[i : i + 50]) for i in range(len(other) - 49)}
            at = [i for i in range(len(w) - 49) if tuple(w[i : i + 50]) in runs]
            begin, to = min(x[0] for x in got[d]), max(x[1] for x in got[d])
            assert 48 <= begin <= at[0] + 5 and at[-1] + 45 <= to <= end + 2
        assert not min(got[k])[2] and all(x[2] for x in got[k + 1])


def test_paragraph_query(spark):
    """Every document that shares 50 words with another one is found; one that shares no 30 is not."""
    from lamella.llm.paragraphs import op1_paragraph_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id for r in op1_paragraph_dedup(spark, sf).collect()}
    assert shared_runs(rows, 50) <= got <= shared_runs(rows, 30) and got


def test_wand_is_exact():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(3, 40), 120)) + ".") for i in range(80)]
    index = decontam.Index.build(items)
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 60))))
        score = np.zeros(len(items))
        for t in terms:
            score[index.items[index.at[t] : index.at[t + 1]]] += index.weights[index.at[t] : index.at[t + 1]]
        for threshold in (0.1, 0.3, 0.6):
            got = dict(index.wand(terms, threshold))
            want = {i: s for i, s in enumerate(score) if s >= threshold - 1e-9}
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 30, 400)) + ". " + " ".join(words(rng, 3, 400)) + ".") for i in range(30)] + [(50, None), (51, ""), (52, "only three words")]
    docs = []
    for k in range(60):
        text = words(rng, 200, 400)
        if k % 3 == 0:
            at = rng.randrange(len(text))
            text[at:at] = items[k // 3][1].upper().split() if k % 2 else items[k // 3][1].split()
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "So only three words here"), (None, items[4][1])]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k // 3) for k in range(0, 60, 3)} | {(102, 52), (None, 4)}
    assert decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_flat_graph_search():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16))
    x[:200] = x[0] + 0.15 * rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    search = Search(x, robust_prune(x), 3, 16)
    who, what = search.ranged(x, 0.95)
    want = set(zip(*np.nonzero(x @ x.T >= 0.95)))
    got = set(zip(who.tolist(), what.tolist()))
    assert got <= {(int(a), int(b)) for a, b in want} and len(got) >= 0.97 * len(want)


def test_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8))
    x[100:130] = x[100] * rng.uniform(0.5, 2, (30, 1)) + 0.02 * rng.standard_normal((30, 8))
    x[130:140] = x[5]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0]]
    rows += [(1000 + i, v, i) for i, v in enumerate(odd)]
    out, recall = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert recall >= 0.9 and len(got) == len(rows)
    found = sum(got[i][0] for i in range(400))
    assert 0.95 * (near.sum() - 400) <= found <= near.sum() - 400
    assert got[131] == (near[131].sum() - 1, 5, False) and got[100][2]
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(odd)))
    assert similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"))[0].count() == 0
    large = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [2.0, 0.0]), (4, [1e-200, 0.0]), (5, [0.0, 1e-300]), (5, [0.0, 1.0])]
    found = similar_vectors(spark.createDataFrame(large, "vec_id long, embedding array<double>"))[0].collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 1, 5), (5, 1, 5)]


def test_vectors_spread_over_shards(spark, monkeypatch):
    """One group over all shards, a length of its own for the least id: every link is found."""
    from lamella.llm import vectors as V

    monkeypatch.setattr(V, "SHARD", 5)
    rng = np.random.default_rng(8)
    x = rng.standard_normal(8) + 0.03 * rng.standard_normal((200, 8))
    y = rng.standard_normal((20, 3))
    rows = [(0, [1.0, 2.0]), *((1 + i, v.tolist()) for i, v in enumerate(x)), *((500 + i, v.tolist()) for i, v in enumerate(y))]
    out, recall = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    links = lambda v: ((u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T >= 0.95).sum(1) - 1
    assert recall >= 0.97 and got[0] == (0, 0) and len(got) == len(rows)
    assert sum(got[1 + i][0] for i in range(200)) >= 0.97 * links(x).sum() > 0 and {got[1 + i][1] for i in range(200)} == {1}
    assert [got[500 + i][0] for i in range(20)] == links(y).tolist()
