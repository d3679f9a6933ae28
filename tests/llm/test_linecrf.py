import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import linecrf as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts by their definitions."""
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def texts():
    r = random.Random(3)
    words = ["a", "be", "çé", "#x", "|", "the", "END", "12", "中文", "\x1cq", "x y"]
    seps = [" ", "\n", "\t", " \n", "\r\n", "\x0b", "  ", "\n\n"]
    out = [None, "", " ", "\n", "a", "a\n", "\na", "a b c a b c", "x\nx\nx "]
    for _ in range(300):
        out.append("".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(1, 150))))
    return out


def test_counts_and_kept(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, "a b", 1), (3, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(3)
    got = m.assess(df, m.Model.zero()).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    for i, t, _ in rows:
        want = plain(t)
        r = by[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, t
        assert r.kept == (not want[5])  # all weights zero: every line is content
    kept = m.keep(df, m.Model.zero())
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert m.assess(df.limit(0), m.Model.zero()).count() == 0


def random_model(r):
    return m.Model(r.normal(size=(len(m.FEATURES), 2)), r.normal(size=(2, 2)), r.normal(size=2))


def score(model, bits, y):
    e = m.expand(bits) @ model.emit
    return model.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("seed", range(15))
def test_viterbi_is_the_best_path_and_sums_are_exact(seed):
    r = np.random.default_rng(seed)
    model = random_model(r)
    n = int(r.integers(1, 9))
    bits = r.integers(0, 1 << len(m.FEATURES), n).astype(np.uint32)
    every = list(itertools.product((0, 1), repeat=n))
    best = max(every, key=lambda y: score(model, bits, y))
    assert tuple(model.viterbi(bits)) == best
    cut = np.array([0, 0, *np.sort(r.integers(0, 60, 7)), 60, 60])
    many = r.integers(0, 1 << len(m.FEATURES), 60).astype(np.uint32)
    alone = np.concatenate([model.viterbi(many[i:j]) for i, j in zip(cut[:-1], cut[1:])])
    assert model.decode(many, cut).tolist() == alone.tolist()
    old, m.SIDE = m.SIDE, 3  # long texts, one by one
    try:
        assert model.decode(many, cut).tolist() == alone.tolist()
    finally:
        m.SIDE = old
    y = r.integers(0, 2, n)
    total = np.logaddexp.reduce([score(model, bits, z) for z in every])
    x, pad = m.expand(bits)[None], 3
    x = np.concatenate([x, np.zeros((1, pad, x.shape[2]))], 1)
    got, grad = m.likelihood(model, x, np.append(y, [0] * pad)[None], np.array([n]))
    assert got == pytest.approx(score(model, bits, y) - total)
    for name, at in (("emit", (0, 1)), ("move", (1, 0)), ("start", (1,))):
        moved = m.Model(model.emit.copy(), model.move.copy(), model.start.copy())
        getattr(moved, name)[at] += 1e-6
        assert (m.likelihood(moved, x, np.append(y, [0] * pad)[None], np.array([n]))[0] - got) / 1e-6 == pytest.approx(getattr(grad, name)[at], abs=1e-3)


def test_training_and_lines(spark):
    good = "Every line here is a plain sentence of several words, and it ends.\n" + "This is another line that reads like prose does, with some words.\n" * 1
    docs, labels = [], []
    r = random.Random(1)
    prose = "here is what some people say about many other things in this old town today".split()
    for i in range(200):
        if i % 2:
            t = "\n".join(" ".join(r.choice(prose) for _ in range(20)).capitalize() + "." for _ in range(6))
        else:
            t = "\n".join(" ".join(r.choice(prose).upper() + "!!" for _ in range(20)) for _ in range(6))
        docs.append((i, t))
        if i < 120:
            labels.append((i, i % 2, None))
    labels += [(5, None, 0), (None, 1, 0), (7, 1, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = m.train(docs, labels)
    got = m.assess(docs.where("doc_id >= 120"), model).collect()
    assert sum(x.kept == bool(x.doc_id % 2) for x in got) >= 78
    lines = m.label_lines(docs.limit(4), model).collect()
    assert len(lines) == 24 and {x.line for x in lines} == set(range(6))
    assert m.train(docs, labels.limit(0)).emit.any() == False  # noqa: E712
    assert good


def mixed(r, kind):
    """Lines with their labels: prose with blocks of boilerplate inside, or boilerplate with little prose."""
    words = "here is what some people say about many other things in this old town today".split()
    prose = lambda: (" ".join(r.choice(words) for _ in range(r.randint(12, 25))).capitalize() + ".", 1)
    junk = {
        "menu": lambda: (" | ".join(r.choice(["Home", "About", "Contact", "Jobs", "News"]) for _ in range(4)), 0),
        "notice": lambda: (r.choice(["Licensed under the terms of the town.", "All rights reserved.", "Copyright of the people, all rights reserved."]), 0),
        "loud": lambda: (" ".join(r.choice(words).upper() + "!!" for _ in range(12)), 0),
        "symbols": lambda: (" ".join(r.choice(words) + "$$$" for _ in range(12)), 0),
    }
    block = lambda n: [junk[k]() for k in [r.choice(list(junk))] for _ in range(n)]
    if kind:
        return [prose() for _ in range(r.randint(3, 6))] + block(r.randint(1, 3)) + [prose() for _ in range(r.randint(3, 6))] + block(r.randint(0, 2))
    return block(r.randint(3, 6)) + [prose() for _ in range(r.randint(0, 1))] + block(r.randint(3, 6))


def test_mixed_documents_get_both_labels(spark):
    r = random.Random(6)
    texts = [mixed(r, i % 3 != 0) for i in range(500)]
    docs = spark.createDataFrame([(i, "\n".join(x for x, _ in t)) for i, t in enumerate(texts)] + [(0, "a\nb")] * 3, "doc_id long, text string").repartition(3)
    model = m.train(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int"))
    got = {}
    for x in m.label_lines(docs.where("doc_id >= 300"), model).collect():
        got.setdefault(x.doc_id, {})[x.line] = int(x.content)
    pairs = [(texts[i][j][1], y) for i, t in got.items() for j, y in t.items()]
    for label in (0, 1):
        own = [y == label for want, y in pairs if want == label]
        assert len(own) > 300 and sum(own) >= 0.95 * len(own)
    both = [len(set(t.values())) == 2 for i, t in got.items() if len({y for _, y in texts[i]}) == 2]
    assert len(both) > 100 and sum(both) >= 0.9 * len(both)
    kept = {x.doc_id: x.n_content_words >= 0.5 * x.n_words for x in m.assess(docs.where("doc_id >= 300"), model).collect()}
    assert sum(k == (i % 3 != 0) for i, k in kept.items()) >= 0.97 * len(kept)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(0, "word " * 300_000), (1, "a line of some words here.\n" * 100_000), (2, "\n" * 300_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in m.assess(docs, m.Model.zero()).collect()}
    assert (got[0].n_words, got[1].n_lines, got[1].n_dup_lines, got[2].n_words) == (300_000, 100_000, 99_999, 0) and got[2].base_failed
