import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import ctw


def naive(train, text, sizes):
    """log10 P(text) after train, from ratios of weighted block probabilities of the explicit tree."""

    def events(t):
        out, hist = [], [32] * len(sizes)
        for x in [*t.lower().encode(), 255]:
            path = [int(ctw.CLASS[hist[-1 - d]]) % s for d, s in enumerate(sizes)]
            p = 1
            for i in range(7, -1, -1):
                out.append((p, tuple(path), x >> i & 1))
                p = 2 * p + (x >> i & 1)
            hist.append(x)
        return out

    seen = Counter(e for t in train for e in events(t))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(counts, d):
        if not counts:
            return 0.0
        n = [sum(v for (path, bit), v in counts.items() if bit == x) for x in (0, 1)]
        if d == len(sizes):
            return kt(*n)
        below = sum(weighted({k: v for k, v in counts.items() if k[0][d] == c}, d + 1) for c in {k[0][d] for k in counts})
        return float(np.logaddexp(kt(*n), below)) - math.log(2)

    total = 0.0
    for p, path, bit in events(text):
        old = {(q, b): v for (pp, q, b), v in seen.items() if pp == p}
        new = dict(old)
        new[path, bit] = new.get((path, bit), 0) + 1
        total += weighted(new, 0) - weighted(old, 0)
    return total / math.log(10)


@pytest.mark.parametrize("sizes", [(32,), (32, 32), (32, 32, 32, 8)])
def test_equals_the_explicit_tree(sizes):
    train = ["abracadabra", "Abra, cadabra\n", "été 12", "", "banana bandana"]
    bufs = [t.encode() for t in train]
    ctx, sym, _ = ctw.contexts(np.frombuffer(b"".join(bufs), np.uint8), np.cumsum([0, *map(len, bufs)]), sizes)
    u, n = np.unique(ctx * 256 + sym, return_counts=True)
    model = ctw.Model(u, n, sizes)
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-4)
    tests = ["abra", "", "zé#", "band", "12 été"]
    data = [t.encode() for t in tests]
    got = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for t, g in zip(tests, got):
        assert g == pytest.approx(naive(train, t, sizes), rel=1e-5)


def test_no_training_rows():
    model = ctw.Model(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert model.score(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0] == pytest.approx(-24 * math.log10(2), rel=1e-5)


@pytest.mark.parametrize("hot", [0, 3, 1 << 19])
def test_words_by_definition(spark, hot):
    texts = {i: f"The cat {'sat ' * (i % 4)}on mat{i % 7} é{i}\x1cx" for i in range(60)} | {60: "", 61: None}
    rows = [(i, t, 1) for i, t in texts.items()] + [(5, texts[5], 2), (None, "the dog", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = ctw.scores(df, hot=hot).collect()
    assert len(got) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter()
    for i, t, _ in rows:
        if not held(i):
            c.update([*word.findall(lower(t)), None])
    total = sum(c.values())
    for r in got:
        t = "the dog" if r.doc_id is None else texts[r.doc_id]
        tokens = [*word.findall(lower(t)), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(c[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in tokens))
        assert r.score < 0
    assert ctw.scores(df.limit(0)).count() == 0


def deep(train, text, depth):
    """log10 P(text) after train over real bytes, from ratios of weighted block probabilities of the explicit tree."""

    def events(t):
        hist = b" " * depth
        for x in [*t.encode(), 255]:
            p = 1
            for i in range(7, -1, -1):
                yield p, hist[::-1][:depth], x >> i & 1
                p = 2 * p + (x >> i & 1)
            hist = (hist + bytes([x]))[-depth:]

    seen = {}
    for p, ctx, bit in (e for t in train for e in events(t)):
        seen.setdefault(p, Counter())[ctx, bit] += 1

    def weighted(counts, d):
        n = [sum(v for (_, bit), v in counts.items() if bit == x) for x in (0, 1)]
        kt = math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(sum(n) + 1)
        if not counts or d == depth:
            return kt
        below = sum(weighted({k: v for k, v in counts.items() if k[0][d] == c}, d + 1) for c in {k[0][d] for k in counts})
        return float(np.logaddexp(kt, below)) - math.log(2)

    total = 0.0
    for p, ctx, bit in events(text):
        old = dict(seen.get(p, {}))
        total += weighted(old | {(ctx, bit): old.get((ctx, bit), 0) + 1}, 0) - weighted(old, 0)
    return total / math.log(10)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_deep_tree_in_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(ctw, "STEP", 3)
    texts = ["abracadabra 17 27", "Abra, cadabra\n", "señor été", "мама мыла раму", "", None, "1234567 x 9234568 y", "été 12 años"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ctw.scores(df, held="doc_id % 3 = 1", size=size).collect()}
    train = [t or "" for i, t in enumerate(texts) if i % 3 != 1]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(deep(train, t or "", ctw.DEPTH), rel=1e-5)


def test_memory_of_a_chunk_that_asks():
    """Grams are merged range by range: nearly 4 million different ones take less than 40 bytes each, all copies included."""
    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=4_000_000))
    t = pa.table({"k": [1], "text": [text], "held_out": [False]})
    tracemalloc.start()
    for _ in ctw.asked(t, ctw.DEPTH):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)


def test_grams_in_ranges_by_definition(monkeypatch):
    monkeypatch.setattr(ctw, "WINDOW", 16)
    texts = ["abracadabra", None, "", "banana bandana " * 9, "été"]
    t = pa.table({"k": range(5), "text": pa.array(texts, pa.string()), "held_out": [i == 3 for i in range(5)]})
    want = Counter()
    for i, x in enumerate(texts):
        data = b" " * 6 + (x or "").encode() + b"\xff"
        for at in range(6, len(data)):
            want[int.from_bytes(data[at - 6 : at][::-1] + data[at : at + 1], "big")] += i != 3
    keys, n = (np.concatenate(x).tolist() for x in zip(*ctw.asked(t, 6)))
    assert (keys, n) == (sorted(want), [want[k] for k in sorted(want)])
    assert ctw.grams(t, 6).tolist() == keys
