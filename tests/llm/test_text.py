"""Words, shingles, prediction by partial matching, tokens: against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm import ppm, repair
from lamella.llm.langid import fit, predict
from lamella.llm.lm import lm_score
from lamella.llm.textkit import Words, column_bytes, distinct_sets, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a", " a  b\n", "A b\tC d é", "one two three four five", "x" * 300 + " y", "a b c d e a b c d e a b", "ü\x0bö\x0c\x1cz", "end "]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_and_shingles():
    buf, off = column_bytes(pa.array(TEXTS, pa.string()))
    words = Words(buf, off)
    want = [WORD.findall(lower(t)) for t in TEXTS]
    assert np.diff(words.first).tolist() == [len(w) for w in want]
    hashes, flat = words.hashes(), [w for ws in want for w in ws]
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))
    values, at = distinct_sets(*shingles(hashes, words.first), len(TEXTS))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in want]
    assert np.diff(at).tolist() == [len(s) for s in sets]


def trie(texts, order, least=0):
    counter = ppm.Counter()
    buf, off = column_bytes(pa.array(texts, pa.string()))
    counter.add(0, ppm.grams(*ppm.stream(buf, off), order))
    found: dict = {}
    for b in counter.rows():
        for key, n in zip(b["key"].to_pylist(), b["n"].to_pylist()):
            for size in range(1, (key >> 56) + 1):
                part = key & ((1 << 8 * size) - 1)
                found.setdefault((size - 1, part >> 8), Counter())[part & 255] += n
    rows = [{"depth": d, "ctx": c, "grp": 0, "symbols": [{"sym": s, "n": n} for s, n in x.items()]} for (d, c), x in found.items() if sum(x.values()) >= least]
    kind = pa.schema([("depth", pa.int32()), ("ctx", pa.int64()), ("grp", pa.int32()), ("symbols", pa.list_(pa.struct([("sym", pa.int32()), ("n", pa.int64())])))])
    return ppm.Trie.build(pa.Table.from_pylist(rows, kind), order, 1), found


def plain_ppm(found, order, text, least):
    """log2 probability by the definition: escape method C with symbol exclusion."""
    held = {k: v for k, v in found.items() if sum(v.values()) >= least}
    data, total = bytes([255]) + text.encode() + bytes([255]), 0.0
    for i in range(1, len(data)):
        past, out = data[max(0, i - order) : i], set()
        past = past[past.rfind(255) :] if 255 in past else past
        p, d = 1.0, len(past)
        while True:
            ctx = int.from_bytes(past[len(past) - d :], "big") if d >= 0 else None
            if d < 0:
                p /= 257 - len(out)
                break
            if (d, ctx) in held:
                seen = {s: n for s, n in held[d, ctx].items() if s not in out}
                n = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    p *= seen[data[i]] / n
                    break
                p *= len(seen) / n if n else 1
                out |= set(seen)
            d -= 1
        total += math.log2(p)
    return total


@pytest.mark.parametrize("order, least", [(1, 0), (3, 0), (4, 3)])
def test_ppm_is_exact(order, least):
    train = ["the cat sat on the mat", "the dog sat", "", "éa", "the the the"]
    t, found = trie(train, order, least)
    model = ppm.Automaton(t)
    texts = ["the cat", "zebra ☃", "", "a", "the dog sat on the mat" * 20]
    buf, off = column_bytes(pa.array(texts))
    got = model.score(*ppm.stream(buf, off))
    assert np.allclose(got, [plain_ppm(found, order, x, least) for x in texts], rtol=1e-5)


def test_language(spark):
    rows = [("the cat and the dog are here", "en"), ("der hund und die katze sind da", "de")] * 20 + [(None, "en"), ("kein", None)]
    langs, model = fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "the dog", 0.5), (2, "und der hund", 0.5), (3, None, 0.5), (4, "123 !?", 0.5), (1, "the dog", 0.5)], "doc_id long, text string, score double")
    got = sorted((r.doc_id, r.lang_pred) for r in predict(docs.drop("score"), langs, model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und")]
    none = fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in predict(docs.drop("score"), *none).collect()} == {"und"}


def test_language_model(spark):
    train, texts = ["a b a c", "a", None, "the b"], [(1, "a b zz"), (2, None), (2, "A  a\n"), (3, "")]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score < 0) for r in lm_score(df, docs, heavy_share=0.3).collect())
    count = Counter(w for t in train for w in [*WORD.findall(lower(t)), "\0"])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in texts:
        ws = [*WORD.findall(lower(t)), "\0"]
        want.append((d, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6), True))
    assert got == sorted(want)


@pytest.mark.parametrize("share", [0.0, 0.004, 0.05, 1.0])
def test_rare_contexts_count(spark, share):
    train = ["the cat sat on the mat", "the dog sat", "", "éa", "the the the", "a zebra sat on a rare quagga", "the cat sat on the mat"]
    texts = ["the cat", "zebra ☃", "", "a", "the quagga sat on the zebra", "zzz", " ".join(["the dog sat on the mat"] * 20), "a rare quagga"]
    _, found = trie(train, 5)
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string")
    got = lm_score(spark.createDataFrame([(t,) for t in train], "text string"), docs, min_share=share).collect()
    want = [plain_ppm(found, 5, t, 0) * math.log10(2) for t in texts]
    assert len(got) == 2 * len(texts) and all(r.score == pytest.approx(want[r.doc_id], rel=1e-5) for r in got)
    none = lm_score(spark.createDataFrame([], "text string"), docs, min_share=share).collect()
    assert all(r.score == pytest.approx((len(texts[r.doc_id].encode()) + 1) * -math.log10(257), rel=1e-5) for r in none) and len(none) == len(got)


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (50, 2), (5000, 3), (40000, 400)):
        ids = rng.integers(0, kinds, n)
        ids = np.append(ids, 0)
        off = np.concatenate([[0], np.flatnonzero(ids == 0) + 1])
        shard = repair.Shard(repair.pack([None, *range(len(off) - 2)], ids, off, 500))
        assert np.array_equal(shard.ids(), ids) and shard.n_ids == len(ids)
        assert shard.doc_ids[0] is None
        for k in range(0, len(off) - 1, max(1, len(off) // 7)):
            assert np.array_equal(shard.read_document(k), ids[off[k] : off[k + 1]])
        assert np.array_equal(shard.read_ids(len(ids) // 2, 9), ids[len(ids) // 2 :][:9])
    with pytest.raises(ValueError):
        repair.Shard(b"x" * 40)


def test_token_shards(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(str(path))
    texts = ["it's  a\n\n test 's x's 've", "日本語 text  \n", " x ", "½ ² µ é'é", "<|endoftext|> x", "a<|endoftext|>", "12 34a5é9\t\t.", "don't", None, "", "the same", "the same"]
    rows = [(100 - i if i != 3 else None, t) for i, t in enumerate(texts)]
    got = sorted(repair.token_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1].tolist()
    assert repair.token_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
