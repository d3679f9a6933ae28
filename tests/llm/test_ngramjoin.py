import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import graph, ngramjoin


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def truth(rows, n, percent):
    s = [sets_of(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
                if s[i] != s[j]:
                    links.add(frozenset((s[i], s[j])))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s[i]), least.get(find(i)) if s[i] else k) for i, (k, _) in enumerate(rows)], links


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(900, ""), (901, None), (902, " \n"), (903, "Hi"), (904, "hi"), (905, "hi you"), (None, "hi you there")]
    k = 0
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice([*vocab, f"x{r.random()}"])
            rows.append((k, "  ".join(w.upper() if r.random() < 0.1 else w for w in t)))
            k += 1
    r.shuffle(rows)
    rows.append(rows[10])
    return rows


@pytest.mark.parametrize("seed,n,percent,share", [(2, 5, 80, 2000), (3, 3, 90, 3)])
def test_components_by_brute_force(spark, monkeypatch, seed, n, percent, share):
    monkeypatch.setattr(ngramjoin, "SHARE", share)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, root string").repartition(3)
    want, links = truth(rows, n, percent)
    join = ngramjoin.NgramJoin(df, n=n, percent=percent)
    got = [tuple(r) for r in join.components().collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert join.links().count() == len(links)
    kept = ngramjoin.dedup(df, n=n, percent=percent)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, {c if c is not None else k for k, _, c in want}))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.components(df).count() == 0 and ngramjoin.dedup(df).count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_graph(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_least_difference_bounds():
    r = np.random.default_rng(5)
    for n, m, common in ((0, 0, 0), (1, 40, 1), (300, 320, 300), (5000, 4700, 4690), (9000, 9000, 0), (70_000, 400, 400)):
        both = r.integers(0, 1 << 63, common, dtype=np.uint64)
        a = np.unique(np.concatenate([both, r.integers(0, 1 << 63, n - common, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, r.integers(0, 1 << 63, m - common, dtype=np.uint64)]))
        true = len(np.setxor1d(a, b))
        low = ngramjoin.least_difference(ngramjoin._parities(a), ngramjoin._parities(b))
        assert low <= true and (low - true) % 2 == 0
        assert low == ngramjoin.least_difference(ngramjoin._parities(b), ngramjoin._parities(a))
        if n == m == 9000:
            assert low > 0.3 * n  # unrelated long sets are told apart, at any length
        if (n, m) == (5000, 4700):
            assert low > 0.9 * true


def test_many_rounds_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "ROUND", 3)
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(30_000)]
    near = base[:]
    near[77] = "other"
    rows = [(i, " ".join(base if i % 2 else near)) for i in range(4)] + [(4, " ".join(base[:15_000])), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (None, "one")]
    for i in range(10, 30):
        t = [f"v{r.randrange(50)}" for _ in range(60)]
        rows += [(i, " ".join(t)), (i + 100, " ".join(t[:-1]))]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, root int, _k int, _SA int")
    got = {x.doc_id: x.component_id for x in ngramjoin.components(df, n=3, percent=90).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None)] == [0, 0, 0, 0, 4, 5, 6, 7, 8, 8, 8]
    assert all(got[i + 100] == i for i in range(10, 30))
    kept = sorted(x.doc_id for x in ngramjoin.dedup(df, n=3, percent=90).collect())
    assert kept == [0, 4, 5, 6, 7, 8, *range(10, 30)]


@pytest.mark.parametrize("few", [0, 1 << 18])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_graph_on_the_driver_and_in_rounds(spark, monkeypatch, few, kind):
    monkeypatch.setattr(graph, "FEW", few)
    pairs = [(i, i + 1) for i in range(20, 60)] + [(9, 5), (5, 9), (7, 9), (3, 3), (None, 4), (70, 61), (61, 90), (90, 60)]
    df = spark.createDataFrame(pairs, "a long, b long").select(*(F.col(c).cast(kind) for c in "ab")).repartition(5)
    got = {int(r.node): int(r.root) for r in graph.components(df, "a", "b").collect()}
    assert got == {i: 20 for i in (*range(20, 62), 70, 90)} | {5: 5, 7: 5, 9: 5}
    assert graph.components(df.limit(0), "a", "b").count() == 0


def test_few_edges_take_few_jobs(spark):
    """A path of 500 edges in some jobs, not some for each round."""
    df = spark.range(500).selectExpr("id as a", "id + 1 as b").repartition(7)
    spark.sparkContext.setJobGroup("few", "few")
    got = graph.components(df, "a", "b").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 501 and {r.root for r in got} == {0}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 10
